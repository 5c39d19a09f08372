from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tessera-tests-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    rows = [(1, "Casa branca, casa azul. Não é casa?", "*grupo_a *sexo_f"), (2, None, None), (3, "", "**** *grupo_b *x"), (4, "azul azul céu!", "*grupo_b *sexo_m"), (5, "azul azul céu!", "*grupo_b *sexo_m *sexo_f")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, etoiles string")
