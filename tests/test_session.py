"""The session helper keeps settings the cluster already made (checked in a fresh JVM)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from reelcat.session import get_spark, checkpoint_dir
s = get_spark()
print("RESULT", s.conf.get("spark.sql.shuffle.partitions"), s.conf.get("spark.sql.session.timeZone"),
      s.conf.get("spark.sql.adaptive.skewJoin.enabled"), bool(checkpoint_dir(s)))
"""


def test_cluster_settings_are_not_overridden():
    env = dict(os.environ)
    env["PYSPARK_SUBMIT_ARGS"] = ("--conf spark.sql.shuffle.partitions=123 "
                                  "--conf spark.sql.session.timeZone=Europe/Berlin pyspark-shell")
    out = subprocess.run([sys.executable, "-c", PROBE], env=env, capture_output=True, text=True, timeout=300)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    # configured keys kept; unset keys get the local defaults
    assert line[0].split()[1:] == ["123", "Europe/Berlin", "true", "True"]
