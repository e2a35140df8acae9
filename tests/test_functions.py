"""Fixed values of the expressions."""

import pytest
from pyspark.sql import functions as F

from pluvia.functions import geo, radar


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_folds(spark):
    for (lat, lon), fold in {(21.0, 105.8): 0, (-33.9, 151.2): 1, (40.7, -74.0): 0, (10.8, 106.7): 1}.items():
        assert one(spark, geo.fold(F.lit(lat), F.lit(lon))) == fold


def test_rates(spark):
    assert one(spark, radar.rain_rate(F.lit(14.9))) == 0
    assert one(spark, radar.rain_rate(F.lit(70.0))) == one(spark, radar.rain_rate(F.lit(55.0)))
    assert abs(one(spark, radar.dbz_of(radar.rain_rate(F.lit(33.0)))) - 33) < 1e-9


def test_subpixel(spark):
    assert one(spark, radar.subpixel(F.lit(0.5), F.lit(1.0), F.lit(0.5))) == 0
    assert one(spark, radar.subpixel(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0
    assert 0 < one(spark, radar.subpixel(F.lit(0.1), F.lit(1.0), F.lit(0.9))) <= 0.5


@pytest.mark.parametrize("degrees,name", [(0, "N"), (44, "NE"), (350, "N"), (181, "S")])
def test_compass(spark, degrees, name):
    assert one(spark, geo.compass(F.lit(degrees))) == name
