"""The sink that publishes whole tables."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.plans.dataset import generate
from tessera.sinks import files, published
from tessera.sinks.files import ExportError
from tessera.sources.config import read_config_text
from tessera.sources.ddl import read_ddl


def test_what_is_written_is_what_rows_says(spark, tmp_path):
    sql = "CREATE TABLE p (id serial PRIMARY KEY, name text, price numeric(8,2), day date, ok boolean); CREATE TABLE c (id serial PRIMARY KEY, p_id int NOT NULL REFERENCES p(id), note text)"
    data = generate(spark, read_ddl(sql), read_config_text("seed: 3\nrows: 50\ntables: {c: {rows: 0}}"))
    top = str(tmp_path / "out")
    assert published.publish(data, top, "json") == {"p": "p.json", "c": "c.json"}
    parts = sorted(os.listdir(f"{top}/p.json"))
    arrays = [json.load(open(f"{top}/p.json/{x}")) for x in parts]  # each part is an array
    rows = data.rows("p").sort("idx").collect()
    found = [r for part in arrays for r in part]
    assert [(r["id"], r["name"], float(r["price"]), r["day"], r["ok"]) for r in found] == [(r["id"], r["name"], float(r["price"]), str(r["day"]), r["ok"]) for r in rows]
    again = spark.read.option("multiLine", True).json(f"{top}/p.json")
    assert again.count() == 50 and [r for x in os.listdir(f"{top}/c.json") for r in json.load(open(f"{top}/c.json/{x}"))] == []
    with pytest.raises(Exception, match="there already"):
        published.publish(data, top, "json")
    assert sorted(os.listdir(top)) == ["c.json", "p.json"]
    published.publish(data, top, "json", overwrite=True)
    published.publish(data, top, "csv")
    back = spark.read.option("header", True).csv(f"{top}/p.csv")
    assert back.count() == 50 and back.columns == ["id", "name", "price", "day", "ok"] and sorted(int(r["id"]) for r in back.collect()) == list(range(1, 51))
    assert sorted(os.listdir(top)) == ["c.csv", "c.json", "p.csv", "p.json"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    lines = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("value"))
    target = str(tmp_path / "t.json")
    with pytest.raises(Exception, match="stop"):
        published.write_lines(lines, target, "json")
    assert os.listdir(tmp_path) == []


def test_names_stay_in_their_folder():
    assert files.contained("/a/b", "t.csv") == "/a/b/t.csv"
    for name in ("../t.csv", "x/../../t", "/etc/t", "", "a/b", "a\\b", ".", ".."):
        with pytest.raises(ExportError):
            files.contained("/a/b", name)
