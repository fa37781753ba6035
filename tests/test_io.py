from __future__ import annotations

from pyspark.sql.types import StructType

from tempora.sources import events as source


def test_concatenated_json(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"timestamp": "2023-01-01 00:00:55.0000 UTC",\n "page": "a", "x": 1}\n{"timestamp": "2023-01-01 00:01:00 UTC"} junk {"timestamp": "no", "page": "b"}{"page": "c"}{"timestamp": "2023-01-01 00:02:00.5 UTC", "page": {"a": 1}}')
    schema = StructType().add("timestamp", "string").add("page", "string")
    got = source.json_events(spark, str(tmp_path / "e.json"), schema).orderBy("seq").collect()
    assert schema.names == ["timestamp", "page"]
    assert [(str(r.timestamp), r.page) for r in got][:2] == [("2023-01-01 00:00:55", "a"), ("2023-01-01 00:01:00", None)]
    out = str(tmp_path / "out")
    source.write_json(spark.range(3).toDF("m"), out)
    assert spark.read.json(out).count() == 3


def test_values_across_blocks():
    """Objects that span blocks, strings with braces, escapes and what isn't JSON."""
    text = '{"a": 1} junk { "b": "}{\\"" }\n{"c": {"d": [1, {"e": "\\\\"}]}} {broken {"f": 2}'
    want = ['{"a": 1}', '{"b": "}{\\""}', '{"c": {"d": [1, {"e": "\\\\"}]}}', '{"f": 2}']
    assert list(source.values([text])) == want
    for size in (1, 3, 7):
        assert list(source.values([text[i : i + size] for i in range(0, len(text), size)])) == want
