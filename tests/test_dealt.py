"""Documents are exchanged once, as texts: their tokens never are. Alignments by bit vectors against plain ones."""

import random
import time

import pytest

from wordloom.functions import sequence as S
from wordloom.queries import QUERIES
from wordloom.session import dealt

from .test_evaluation_plain import aligned, distance

SF = "/root/testdata/sf0.001"


def exchanges(frame) -> list[str]:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["document_errors", "parsed_documents", "span_entities", "bio_tags", "tag_correction", "lowered_text", "tag_repair", "numeric_leftovers", "aligned_entity_texts", "entity_pairs"])
def test_tokens_stay_with_their_document(spark, name):
    found = exchanges(QUERIES[name](spark, SF))
    assert found and all("REPARTITION_BY_NUM" in line for line in found)


@pytest.mark.parametrize("name", ["span_entities", "entity_pairs", "aligned_entity_texts"])
def test_tokens_stay_in_large_tables(spark, name):
    """Large tables are not broadcast; joins of tokens by document and place would then exchange them once more."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = QUERIES[name](spark, SF)
        found = exchanges(frame)
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found and all("REPARTITION_BY_NUM" in line for line in found)
    assert name != "span_entities" or "Sort" not in plan and "Join" not in plan


def test_partitions_follow_the_files(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert dealt(docs, "doc_id").rdd.getNumPartitions() == 4
    monkeypatch.setattr("wordloom.session.DEALT_BYTES", 10_000)
    assert dealt(docs, "doc_id").rdd.getNumPartitions() > 8
    assert dealt(spark.createDataFrame([(1,)], "doc int"), "doc").rdd.getNumPartitions() == 4


@pytest.mark.parametrize("slots", [16, 8192])
def test_bands_match_plain(monkeypatch, slots):
    monkeypatch.setattr(S._Band, "PLACES", slots)
    monkeypatch.setattr(S._Band, "SHORT", slots // 2)
    rng = random.Random(slots)
    for _ in range(150):
        kinds = rng.choice([1, 3, 30])
        a = [str(rng.randrange(kinds)) for _ in range(rng.randrange(70))]
        b = [w if rng.random() > 0.2 else "x" for w in a if rng.random() > 0.2] if rng.random() < 0.6 else [str(rng.randrange(kinds)) for _ in range(rng.randrange(70))]
        want = aligned(a, b)
        assert [(r, h) for r, h, _ in S.align_tokens(a, b)] == want
        ops = [o for _, _, o in S.align_tokens(a, b)]
        assert S.align_counts(a, b) == tuple(ops.count(o) for o in ("equal", "substitute", "delete", "insert"))
        assert S.edit_distance("".join(a), "".join(b)) == distance("".join(a), "".join(b))


def test_cut_texts():
    words = [f"w{i}" for i in range(100)]
    hyp = words[:20] + words[60:]
    assert S.cut_texts(" ".join(words), " ".join(hyp), 30) == (" ".join(words[:20]), " ".join(words[:20]))
    assert S.cut_texts(" ".join(words), " ".join(words[40:]), 30) == (" ".join(words), " ".join(words[40:]))
    assert S.cut_texts(" ".join(words), " ".join(hyp), 41) == (" ".join(words), " ".join(hyp))
    assert S.cut_texts(None, "a", 30) == (None, "a")


def test_long_alignments_are_quick():
    rng = random.Random(5)
    ref = [str(int(rng.paretovariate(0.6))) for _ in range(9000)]
    hyp = [w if i % 5 else w + "q" for i, w in enumerate(ref) if i % 7 != 6]
    began = time.process_time()
    assert sum(S.align_counts(ref, hyp)[:3]) == len(ref)
    assert time.process_time() - began < 1.5
