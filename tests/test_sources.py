import hashlib
import json

import pytest

from basalt.sources.artifacts import JOURNAL, ArtifactError, ArtifactTable
from basalt.sources.json_files import load_instance, load_run_manifest, read_jsonl, write_jsonl, write_object

REQUIRED = {"evidence": ["kind", "content"], "graph": ["nodes"]}


def _rows(spark, rows):
    return spark.createDataFrame(rows, "artifact_type string, instance_id string, producer string, payload string, created_at string, parent_ids array<string>")


def test_artifacts(spark, tmp_path):
    store = ArtifactTable(spark, f"{tmp_path}/a", REQUIRED).create()
    one = ("evidence", "i1", "me", '{"content":"x","kind":"k"}', "2026-01-01T00:00:00Z", None)
    two = ("evidence", "i1", "me", '{"content":"y","kind":"k"}', "2026-01-02T00:00:00Z", None)
    assert store.put(_rows(spark, [two, one])) == 2
    assert store.put(_rows(spark, [one])) == 0
    first = store.list("evidence", "i1").where("payload like '%x%'").first()
    assert store.put(_rows(spark, [("graph", "i1", "me", '{"nodes":[]}', None, [first.artifact_id])])) == 1
    assert json.loads(store.latest().where("artifact_type = 'evidence'").first().payload)["content"] == "y"
    assert store.find_by_content_hash(first.content_hash).count() == store.get(first.artifact_id).count() == 1
    assert store.verify().count() == 0 and store.digest() == store.digest() != store.digest(["graph"])
    for bad in (("graph", "i1", "me", "{}", None, None), ("other", "i1", "me", "{}", None, None), ("graph", "i", "me", '{"nodes":1}', None, ["none"])):
        with pytest.raises(ArtifactError):
            store.put(_rows(spark, [bad]))
    digest = store.sequential_digest()
    ids = sorted((r.artifact_id, r.artifact_type, r.instance_id, r.content_hash) for r in store.rows().collect())
    records = [dict(zip(("artifact_id", "artifact_type", "instance_id", "content_hash"), x, strict=True)) for x in ids]
    assert digest == hashlib.sha256(json.dumps(records, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert [r.place for r in store.read_envelopes().orderBy("place").collect()] == [1, 2, 3] and store.recover() == {"artifacts": 3}
    name = "evidence-" + hashlib.sha256(json.dumps(["i1", first.content_hash, [], "me", "ACTIVE"], separators=(",", ":")).encode()).hexdigest()[:24]
    assert first.artifact_id == name
    spark.createDataFrame([("gone", "evidence", "i1", "x", None, 2)], JOURNAL).write.mode("append").parquet(store.journal_path)
    assert [(r.artifact_id, r.error) for r in store.verify().collect()] == [("gone", "journal entry without envelope")]
    store.export_jsonl(f"{tmp_path}/out", "evidence")
    assert read_jsonl(spark, f"{tmp_path}/out", "artifact_id string").count() == 2


def test_json(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"instance_id": "a",\n "issue": "b", "visible_tests": []}')
    assert load_instance(spark, f"{tmp_path}/i.json").first().issue == "b"
    write_object(spark.createDataFrame([("r1", {"model": "m"})], "run_id string, config map<string,string>"), f"{tmp_path}/m")
    assert load_run_manifest(spark, f"{tmp_path}/m").first().config == {"model": "m"}
    with pytest.raises(ValueError):
        write_object(spark.range(2), f"{tmp_path}/n")
    write_jsonl(spark.range(3), f"{tmp_path}/r")
    assert read_jsonl(spark, f"{tmp_path}/r", "id long").count() == 3
