"""The driver's entry points, with and without the text subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "eftpl" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_text_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "voxmill"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "voxmill/llm")], check=True)
    made = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
    count, some = made.stdout.split()
    assert int(count) > 60 and some == "False", made.stderr


def test_imports_with_the_folder_left_empty(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "voxmill"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(f"rm -rf {tmp_path}/voxmill/llm/*; mkdir -p {tmp_path}/voxmill/llm/__pycache__", shell=True, check=True)
    made = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
    assert made.stdout.strip() == "False", made.stderr
