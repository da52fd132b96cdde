from __future__ import annotations

import json
import random

import pytest

from tallyhouse.sources import nested, split_json

ODD = ["record_id", '"record_id"', 'a "record_id": {[ b', "}]}, {", "\\", '\\"', "é\n\t", "", '"table_name": "x"', "\"records\": [{"]


def _file(rng, source, names):
    tables = []
    for name in names:
        records = []
        for k in range(rng.choice([0, 1, 7, 40])):
            values = {"n": k, "t": rng.choice(ODD), "flag": rng.random() < 0.5, "none": None, "record_id": rng.choice(ODD)}
            if rng.random() < 0.7:
                values["ref"] = {"table": name, "record_id": f"r{k}"}
            if rng.random() < 0.3:
                values["other"] = {"table": "zz", "record_id": rng.choice(ODD)}
            records.append({"record_id": f"{rng.choice(ODD)}{k}", "values": values})
        tables.append({"table_name": name, "match_columns": rng.choice([["n"], ["record_id", "t"], []]), "records": records})
    return {"source_id": source, "tables": tables}


def _rows(df):
    """Rows in order, with references in one spelling (the white space of their text is the parser's business)."""
    def value(text):
        return json.dumps(json.loads(text)) if text and text.startswith("{") else text

    return sorted(repr((r.source_id, r.source_file.rsplit("/", 1)[1], r.table_name, list(r.match_columns), r.record_id,
                        sorted((k, value(v)) for k, v in r["values"].items()))) for r in df.collect())


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_give_what_the_whole_file_gives(spark, tmp_path, split, indent):
    rng = random.Random(split)
    paths = []
    for k in range(3):
        path = tmp_path / f"f{k}.json"
        path.write_text(json.dumps(_file(rng, f"s{k}", [f"t{k}{j}" for j in range(4)]), indent=indent, ensure_ascii=False))
        paths.append(path.name)
    whole = nested.read_records(spark, str(tmp_path), paths)
    old = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = split_json.read_records(spark, [f"{tmp_path}/{name}" for name in paths])
        assert _rows(found) == _rows(whole)
        if split == 97:
            ranges = split_json._pieces(spark, [f"{tmp_path}/{paths[0]}"]).select("range").distinct().count()
            assert ranges > 5
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_a_file_without_records_or_without_names(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source_id": "s", "tables": [{"table_name": "t", "match_columns": [], "records": []}]}))
    assert split_json.read_records(spark, [f"{tmp_path}/a.json"]).collect() == []
    (tmp_path / "b.json").write_text(json.dumps(
        {"source_id": "s", "tables": [{"records": [{"record_id": "r", "values": {}}], "table_name": "t", "match_columns": []}]}))
    with pytest.raises(Exception, match="no table is named"):
        split_json.read_records(spark, [f"{tmp_path}/b.json"]).collect()
