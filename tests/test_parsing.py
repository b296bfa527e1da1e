"""Aligned XML goes from Python as flat Arrow columns, in parts, without a Python object for each sentence."""

import pyarrow as pa

from wordloom.sources import transcripts as T


def xml(*words: str) -> str:
    return "<a><p><s>" + "".join(f'<t>{w}<n pronunciation="_{w}" start="{i}" end="{i + 1}"/></t>' for i, w in enumerate(words)) + "</s></p></a>"


def test_documents_without_xml_have_no_sentences(spark):
    files = spark.createDataFrame([("none", None), ("broken", "<a><p>"), ("bare", "<a/>"), ("one", xml("a", "b"))], "doc string, xml string")
    parsed = T.parse_aligned(files)
    assert "MapInArrow" in parsed._jdf.queryExecution().executedPlan().toString()
    found = {r.doc: [s.ptoks for s in r.sentences] for r in parsed.collect()}
    assert found == {"none": [], "broken": [], "bare": [], "one": [["a ", "b"]]}


def test_a_sentence_that_fails_leaves_nothing_behind():
    found = T._Sentences()
    found.add_document("<a><p><s><t>x<n pronunciation='_x' start='1'/></t><t>y<n pronunciation='_y' start='z'/></t></s></p></a>")
    found.add_document(xml("w"))
    column = found.column()
    assert isinstance(column, pa.ListArray)
    assert column.to_pylist() == [[], [{"ptoks": ["w"], "ntoks": ["w"], "times": [{"start": 0, "end": 1}]}]]
