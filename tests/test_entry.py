"""The entry works without the training-data operators: folders deleted, a folder left over, a library missing."""

import os
import shutil
import subprocess
import sys

import pytest

from segue.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))"


def said(at, code=SAYS):
    env = os.environ | {"PYTHONPATH": f"{at}:{os.environ.get('PYTHONPATH', '').replace(ROOT, str(at))}", "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", code], cwd=at, env=env, capture_output=True, text=True, check=True).stdout.split()


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    os.remove(tmp_path / "copy" / "corpus_pipeline.py")
    return tmp_path / "copy"


def test_without_the_folders(copy):
    assert said(copy) == [str(len(registry.queries())), str(len(registry.oracle_sql())), "False"]
    (copy / "segue" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion by git leaves
    assert said(copy)[2] == "False"


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/segue/llm"), reason="the folder is not there")
def test_without_a_library():
    hidden = "import sys; sys.modules['tokenizers'] = sys.modules['public_tokenizers'] = None; "
    assert said(ROOT, hidden + SAYS) == [str(len(registry.queries())), str(len(registry.oracle_sql())), "False"]
    assert said(ROOT)[2] == "True"
