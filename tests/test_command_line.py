from __future__ import annotations

import json

import pytest

from lodestone.__main__ import main
from tests.golden import TEXT


@pytest.mark.parametrize("algorithm", ["efim", "fhm"])
def test_command_line(spark, tmp_path, capsys, algorithm):
    (tmp_path / "db.txt").write_text(TEXT)
    args = ["-i", str(tmp_path / "db.txt"), "-m", "30", "-a", algorithm, "-s", "global"]
    assert main([*args, "--json"], spark) == 0
    out, err = capsys.readouterr()
    assert sorted(out.split("\n")[:2]) == ["2 3 5 #UTIL: 33", "2 5 #UTIL: 33"]
    assert json.loads(err.strip().splitlines()[-1])["result"]["n_itemsets"] == 2
    assert main([*args, "-o", str(tmp_path / "out")], spark) == 0
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert "n_itemsets: 2" in capsys.readouterr().err


def test_wrong_options(tmp_path):
    with pytest.raises(SystemExit):
        main(["-i", "x", "-m", "1", "-a", "other"])
    with pytest.raises(SystemExit):
        main(["-i", "x"])
