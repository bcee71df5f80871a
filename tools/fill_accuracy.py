"""python tools/fill_accuracy.py SF: how well hidden values of problem 1 come back, by field and source."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trellis.operators.fill import hidden_accuracy
from trellis.plans.problems import patient_fill_spec
from trellis.session import local_session, table

if __name__ == "__main__":
    spark, d = local_session(cpus=8), f"/root/testdata/{sys.argv[1]}"
    spark.sparkContext.setLogLevel("ERROR")
    hidden_accuracy(table(spark, d, "msk_chord_patient_level"), patient_fill_spec(spark, d)).orderBy("field_name", "source").show(truncate=False)
