"""The pipeline over the small tables, stage by stage."""

import importlib
import re

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from ticklane.llm import queries

pipeline = importlib.import_module("corpus_pipeline")


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, len(numbers) + 1))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.table(spark, SMALL, "documents"), {}
    out["documents"] = docs
    for name, stage in pipeline.STAGES:
        docs = out[name] = pipeline.stored(stage(spark, docs, SMALL), f"test-{name}")
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == stages["documents"].columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_join", "decontamination", "pii", "bpe"]


def test_decisions_take_effect(spark, stages):
    own = lambda name: queries.QUERIES[name](spark, SMALL)
    toxic = {r.doc_id for r in own("op7_toxicity").filter("toxic = 1").collect()}
    assert toxic and ids(stages["toxicity"]) == [d for d in ids(stages["documents"]) if d not in toxic]
    near = ids(stages["near_join"])
    assert set(near) < set(ids(stages["toxicity"]))
    leaks = {r.doc_id for r in own("op8_decontamination").collect()}
    assert leaks & set(near) and ids(stages["decontamination"]) == [d for d in near if d not in leaks]
    assert ids(stages["pii"]) == ids(stages["bpe"]) == ids(stages["decontamination"])
    assert stages["pii"].filter("text like '%[EMAIL]%'").count() > 0
    assert stages["pii"].filter(r"text rlike '[a-z]@[a-z]+[.]'").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(pipeline.run(spark, SMALL)) == rows(stages["bpe"])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_results_cover_the_whole_table(spark, name):
    key, source = ("page_id", "pages") if name.startswith("op4") else ("doc_id", "documents")
    found = sorted(r[0] for r in queries.QUERIES[name](spark, SMALL).select(key).collect())
    assert found == sorted(r[0] for r in queries.table(spark, SMALL, source).select(key).collect())
