"""Each stage of the pipeline against a plain version on its own input."""

import re

import corpus_pipeline
from tests.llm import plain
from wordloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from wordloom.llm.tokens import WordEncoder
from wordloom.llm.toxicity import score_toxicity
from wordloom.session import Scratch

SF = "/root/testdata/sf0.001"


def normal(text):
    return [w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in (text or "").split()) if w]


def aligned_share(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best / (2 * len(item))


def test_stages(spark):
    scratch = Scratch(spark, "test")
    inputs, frames = {}, spark.read.parquet(f"{SF}/documents.parquet")
    columns = frames.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = frames
        frames = scratch.keep(stage(spark, frames, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frames.columns == columns
    texts = {n: {r.doc_id: r.text for r in f.collect()} for n, f in inputs.items()}
    names = [n for n, _ in corpus_pipeline.STAGES]

    scored = score_toxicity(inputs["toxicity"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts["near_dedup"]) == {r.doc_id for r in scored.where("predicted = 0").collect()}

    rows = sorted(texts["near_dedup"].items())
    kept = {doc for (doc, _), (n, least) in zip(rows, plain.near_components(rows)) if n == 0 or doc == least}
    assert set(texts["substring_dedup"]) == kept

    rows = sorted(texts["substring_dedup"].items())
    cut = plain.cut_repeats([t for _, t in rows])
    assert texts["decontamination"] == {doc: t if c[1] == 0 else c[3] for (doc, t), c in zip(rows, cut)}

    items = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(texts["decontamination"]) - set(texts["packing"])
    for doc, text in texts["decontamination"].items():
        words = normal(text)
        grams = {tuple(words[i : i + 8]) for i in range(len(words))}
        suspects = [i for i in items if any(tuple(i[k : k + 8]) in grams for k in range(len(i) - 7))] if doc not in gone else items
        assert (max((aligned_share(i, words) for i in suspects), default=0) >= 0.4) == (doc in gone)

    encoder = WordEncoder.of(tokenizer_file())
    rows = frames.collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {doc: len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for doc, t in texts["packing"].items()}
    assert len({r.sequence_id for r in rows}) <= sum(total.values()) // 4096 + 2
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE_SQL) == {"op2_license_scan", "op5_url_cascade", "op9_line_frequency", "op11_hard_negatives", "op12_prefix_trie", "op13_source_mix"}
