"""The given sample and its given results (fixed values in tests/golden), by the command line."""

import json
from pathlib import Path

import pytest

from confluo.plans.cli import main

HERE = Path(__file__).resolve().parent / "golden"


@pytest.mark.parametrize(("shape", "result"), [(None, "default.json"), ("shape.json", "custom.json")])
def test_golden(spark, tmp_path, shape, result):
    out = tmp_path / "out.json"
    chosen = ["--config", str(HERE / shape)] if shape else []
    assert main(["--csv", str(HERE / "people.csv"), "--resume", str(HERE / "resume.txt"), "--out", str(out), *chosen], spark) == 0
    assert json.loads(out.read_text()) == json.loads((HERE / result).read_text())
