"""Session helpers: checkpoint directory and package shipping."""

import glob
import zipfile

from codeweave import session as S


def test_ship_code_once_into_checkpoint_dir(spark):
    root = S.ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == root
    before = set(glob.glob(f"{root}/codeweave-code-*.zip"))
    S.ship_code(spark)          # already shipped by get_spark: no new file
    after = set(glob.glob(f"{root}/codeweave-code-*.zip"))
    assert after == before and len(after) >= 1
    with zipfile.ZipFile(sorted(after)[0]) as zf:
        names = zf.namelist()
    assert "codeweave/operators/entities.py" in names and "codeweave/__init__.py" in names
