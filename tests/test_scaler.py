from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.ml import Pipeline, PipelineModel

from scorebook.models.scaler import Scaler, ScalerModel
from scorebook.operators import scaling

ROWS = [(float(i), 10.0 - i * i, 3.0, [float(i), 2.0 * i * i], [[float(i), 1.0], [i * 3.0, -2.0 * i]]) for i in range(7)]
KIND = "a double, b double, c double, v array<double>, s array<array<double>>"
LAYOUTS = {
    "columns": ({"layout": "columns", "columns": ["a", "b", "c"]}, lambda df, fit: scaling.standardized(df, ["a", "b", "c"], fit)),
    "vector": ({"layout": "vector", "columns": ["v"], "width": 2}, lambda df, fit: scaling.standardized_vector(df, "v", 2, fit)),
    "pooled": ({"layout": "pooled", "columns": ["s"], "width": 2}, lambda df, fit: scaling.standardized_sequence(df, "s", 2, fit)),
}


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_saved_and_loaded_statistics_scale_other_data(data, tmp_path, layout):
    options, direct = LAYOUTS[layout]
    train, other = data.where("a < 5"), data.where("a >= 5")
    Scaler(**options).fit(train).save(str(tmp_path / "m"))
    back = ScalerModel.load(str(tmp_path / "m"))
    assert back.transform(other).collect() == direct(other, train).collect()


def test_a_fresh_process_applies_them(data, tmp_path):
    options, direct = LAYOUTS["vector"]
    Scaler(**options).fit(data).save(str(tmp_path / "m"))
    data.write.json(str(tmp_path / "rows"))
    script = f"""
import json
from scorebook.session import local_session
from scorebook.models.scaler import ScalerModel
spark = local_session("2", "apply", "1g")
rows = spark.read.schema("{KIND}").json("{tmp_path}/rows")
print("ROWS" + json.dumps(sorted(r.v for r in ScalerModel.load("{tmp_path}/m").transform(rows).collect())))
"""
    root = str(Path(__file__).resolve().parent.parent)
    out = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, check=True).stdout
    got = json.loads(next(line for line in out.splitlines() if line.startswith("ROWS"))[4:])
    assert got == sorted(r.v for r in direct(data, data).collect())


def test_as_a_stage_of_a_pipeline(data, tmp_path):
    options = [LAYOUTS[n][0] for n in ("columns", "pooled")]
    model = Pipeline(stages=[Scaler(**o) for o in options]).fit(data)
    model.save(str(tmp_path / "p"))
    assert PipelineModel.load(str(tmp_path / "p")).transform(data).collect() == model.transform(data).collect()


def test_constant_places_wrong_widths_and_no_rows(data):
    model = Scaler(layout="columns", columns=["c"]).fit(data)
    assert {r.c for r in model.transform(data).collect()} == {0.0}
    with pytest.raises(Exception, match="length 3"):
        ScalerModel(layout="vector", columns=["v"], width=3, mean=[0.0] * 3, std=[1.0] * 3).transform(data).collect()
    with pytest.raises(ValueError, match="no rows"):
        Scaler(layout="columns", columns=["a"]).fit(data.limit(0))
    with pytest.raises(ValueError, match="one column"):
        Scaler(layout="vector", columns=["v", "s"], width=2).fit(data)
    with pytest.raises(ValueError, match="unknown layout"):
        Scaler(layout="rows", columns=["a"]).fit(data)
