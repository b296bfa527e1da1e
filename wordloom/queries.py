"""The registered queries of the engine and their DuckDB texts.

The driver's tables stand in for speech: ``events`` of a user, in milliseconds since the user's first, are timed
words; ``documents`` are transcripts, and a fixed damage to them makes hypotheses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import encode as E
from .functions import sequence as S
from .functions import text as X
from .operators import entities, evaluation, selection, tags, windows
from .session import Scratch, dealt, ship
from .streaming.chunks import finished_chunks
from .streaming.windows import stream_sections

HOUR = 3_600_000
LEFT, MID, RIGHT = 6 * HOUR, 24 * HOUR, 6 * HOUR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins -------------------------------------------------------------------------------------------------------


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc, pos, tok), pos from 0."""
    return docs.select("doc", F.posexplode(X.split_tokens(F.col("text"))).alias("pos", "tok"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all transcripts, lying by document."""
    return tokens(dealt(transcripts(spark, sf_dir), "doc"))


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, idx, word, start, end): events of a user as timed words, an end being 500 ms after the start."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    own = Window.partitionBy("user_id")
    start = F.expr("(us - first) div 1000")
    rows = events.withColumn("first", F.min("us").over(own)).withColumn("start", start).withColumn("idx", (F.row_number().over(own.orderBy("us", "event_id")) - 1))
    return rows.select(F.col("user_id").alias("doc"), "idx", F.col("event_type").alias("word"), "start", (F.col("start") + 500).alias("end"))


def damage(tok: Column, pos: Column) -> Column:
    """A token as damaged: every seventh is missing, every fifth is lower case, every third loses its mark."""
    lowered = F.when((pos + 1) % 5 == 0, F.lower(tok)).otherwise(tok)
    return F.when((pos + 1) % 7 == 0, "*").when((pos + 1) % 3 == 0, F.regexp_replace(lowered, "[.!;,?]$", "")).otherwise(lowered)


def damaged(rows: DataFrame) -> DataFrame:
    """(doc, pos, ref, hyp) of token rows, pos from 1."""
    return rows.select("doc", (F.col("pos") + 1).alias("pos"), F.col("tok").alias("ref"), damage(F.col("tok"), F.col("pos")).alias("hyp"))


#: White space as ``functions.text.SPACE`` has it, for RE2.
SPACES = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DOCS = "d AS (SELECT doc_id AS doc, text FROM documents)"
TOKENS = f"{DOCS}, l AS (SELECT doc, list_filter(string_split_regex(text, '{SPACES}+'), lambda x: x <> '') AS ws FROM d), t AS (SELECT doc, unnest(ws) AS tok, generate_subscripts(ws, 1) - 1 AS pos FROM l)"
DAMAGED = f"{TOKENS}, lowd AS (SELECT doc, pos, tok, CASE WHEN (pos + 1) % 5 = 0 THEN lower(tok) ELSE tok END AS low FROM t), dm AS (SELECT doc, pos, tok AS ref, CASE WHEN (pos + 1) % 7 = 0 THEN '*' WHEN (pos + 1) % 3 = 0 THEN regexp_replace(low, '[.!;,?]$', '') ELSE low END AS hyp FROM lowd)"
EVENTS = "e0 AS (SELECT user_id AS doc, event_id, event_type AS word, epoch_us(ts) AS us FROM events), e1 AS (SELECT doc, word, (us - min(us) OVER (PARTITION BY doc)) // 1000 AS start, row_number() OVER (PARTITION BY doc ORDER BY us, event_id) - 1 AS idx FROM e0), w AS (SELECT doc, idx, word, start, start + 500 AS \"end\" FROM e1)"
MEMBERS = f"{EVENTS}, tot AS (SELECT doc, arg_max(\"end\", idx) AS total FROM w GROUP BY doc), ks AS (SELECT doc, unnest(generate_series(0, (total - 1) // {MID})) AS k FROM tot), m AS (SELECT w.*, k, s.side FROM ks JOIN w USING (doc), (VALUES ('left'), ('mid'), ('right')) s(side) WHERE CASE side WHEN 'left' THEN start >= greatest(0, k * {MID} - {LEFT}) AND start < k * {MID} WHEN 'mid' THEN start >= k * {MID} AND start < (k + 1) * {MID} ELSE start >= (k + 1) * {MID} AND start < (k + 1) * {MID} + {RIGHT} END)"
SECTIONS = f"{MEMBERS}, sec AS (SELECT doc, k, side, arg_min(start, idx) AS start_time, arg_max(\"end\", idx) AS end_time, min(idx) AS start_index, max(idx) + 1 AS end_index FROM m GROUP BY doc, k, side)"
CHUNKS = f"{SECTIONS}, wide AS (SELECT doc, k, max(CASE WHEN side = 'left' THEN start_time END) AS ls, max(CASE WHEN side = 'mid' THEN start_time END) AS ms, max(CASE WHEN side = 'mid' THEN end_time END) AS me, max(CASE WHEN side = 'right' THEN end_time END) AS re, max(CASE WHEN side = 'right' THEN start_time END) AS rs, max(CASE WHEN side = 'left' THEN end_time END) AS le FROM sec GROUP BY doc, k), ch AS (SELECT * FROM wide WHERE coalesce(ms, 0) <> 0 AND coalesce(me, 0) <> 0)"
RULE = "CASE WHEN contains(tok, '-') AND prev = 'ISBN' THEN 'ISBN' WHEN regexp_matches(tok, '\\p{Nd}') AND (contains(tok, 'AM') OR contains(tok, 'PM')) THEN 'TIME' WHEN regexp_matches(tok, '^(\\d{3}-\\d{3}-\\d{4}|\\d{3}-\\d{4})') THEN 'PHONE_NUM' WHEN contains(tok, '@') THEN 'EMAIL' WHEN contains(tok, 'www.') OR contains(tok, '.com') OR contains(tok, '.asp') THEN 'URL' END"
RULED = f"{TOKENS}, p AS (SELECT doc, pos, tok, lag(tok) OVER (PARTITION BY doc ORDER BY pos) AS prev FROM t), r AS (SELECT doc, pos, tok, {RULE} AS label FROM p)"


# ---- tokens and cleaning ---------------------------------------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT count(DISTINCT doc) AS docs, count(*) AS tokens, count(DISTINCT tok) AS distinct_tokens, sum(length(tok)) AS chars FROM t")
def token_stats(spark, sf_dir):
    return tokens(transcripts(spark, sf_dir)).agg(F.count_distinct("doc").alias("docs"), F.count(F.lit(1)).alias("tokens"), F.count_distinct("tok").alias("distinct_tokens"), F.sum(F.length("tok")).alias("chars"))


@query(f"WITH {RULED} SELECT label, count(*) AS n FROM r WHERE label IS NOT NULL GROUP BY label")
def entity_counts(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir).withColumn("prev", F.lag("tok").over(Window.partitionBy("doc").orderBy("pos")))
    return rows.withColumn("label", entities.rule_label(F.col("tok"), F.col("prev"))).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def spoken(rows: DataFrame) -> DataFrame:
    """Token rows (doc, pos, ntok, ptok): what holds a digit was spoken as two words, lone marks were not spoken."""
    tok = F.col("tok")
    ntok = F.when(tok.rlike("[0-9]"), "some number").when(X.in_punctuation(tok), "").otherwise(F.lower(tok))
    return entities.with_offsets(rows.select("doc", "pos", ntok.alias("ntok"), tok.alias("ptok")))


@query(f"""WITH {RULED}, n AS (SELECT *, translate(tok, '.,-', '') AS bare FROM r WHERE label IS NULL AND regexp_matches(tok, '[0-9]'))
SELECT doc, pos AS puncted_start, tok AS val FROM n WHERE length(bare) > 0 AND (regexp_matches(bare, '^\\p{{Nd}}+$') OR (length(bare) > 1 AND length(regexp_replace(bare, '[^\\p{{Nd}}]', '', 'g')) >= 0.4 * length(bare)))""")
def numeric_leftovers(spark, sf_dir):
    rows = spoken(doc_tokens(spark, sf_dir))
    return entities.numeric_leftovers(rows, entities.rule_entities(rows)).select("doc", "puncted_start", "val")


OFFSETS = f"""{TOKENS}, s AS (SELECT doc, pos, tok, CASE WHEN regexp_matches(tok, '[0-9]') THEN 2 WHEN contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', tok) THEN 0 ELSE 1 END AS width FROM t)"""


@query(f"WITH {OFFSETS}, o AS (SELECT doc, sum(width) OVER (PARTITION BY doc ORDER BY pos) - width AS nstart, width FROM s) SELECT doc, CAST(sum(width) AS BIGINT) AS words, count(*) AS tokens, CAST(max(nstart) AS BIGINT) AS last_start FROM o GROUP BY doc")
def word_offsets(spark, sf_dir):
    return spoken(doc_tokens(spark, sf_dir)).groupBy("doc").agg(F.sum(F.col("nend") - F.col("nstart")).alias("words"), F.count(F.lit(1)).alias("tokens"), F.max("nstart").cast("long").alias("last_start"))


@query(f"WITH {TOKENS} SELECT right(tok, 1) AS mark, count(*) AS n FROM t WHERE right(tok, 1) IN ('.', '!', ';', ',', '?') GROUP BY 1")
def punct_marks(spark, sf_dir):
    return tokens(transcripts(spark, sf_dir)).withColumn("mark", X.final_mark(F.col("tok"))).where("mark is not null").groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DOCS}, a AS (SELECT doc, translate(replace(text, '*|', ' '), '"''&’‘”“—(){{}}', '            ') AS t FROM d),
b AS (SELECT doc, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([\\p{{Nd}}]+) %', '\\1%', 'g'), '(\\[[A-Z_]+\\]) ([A-Za-z0-9])', '\\1\\2', 'g'), '([A-Za-z0-9]) (\\[/[A-Z_]+\\])', '\\1\\2', 'g'), '[^\\p{{L}}\\p{{N}}_{SPACES[1:-1]}!-/:-@\\[-`{{-~]+', '', 'g') AS t FROM a),
c AS (SELECT doc, list_filter(string_split_regex(t, '{SPACES}+'), lambda x: x <> '' AND x NOT IN ('.', '!', ';', ',', '?') AND NOT contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', x)) AS ws FROM b)
SELECT doc, len(ws) AS n_tokens, md5(array_to_string(ws, ' ')) AS cleaned FROM c""")
def preclean_text(spark, sf_dir):
    out = transcripts(spark, sf_dir).withColumn("clean", X.preclean(F.col("text")))
    return out.select("doc", F.size(X.split_tokens(F.col("clean"))).cast("long").alias("n_tokens"), F.md5(F.col("clean").cast("binary")).alias("cleaned"))


@query(f"WITH {TOKENS} SELECT d.doc, md5(string_agg(regexp_replace(tok, '[.!;,?]$', ''), ' ' ORDER BY pos) FILTER (WHERE regexp_replace(tok, '[.!;,?]$', '') <> '')) AS normal FROM d LEFT JOIN t ON d.doc = t.doc GROUP BY d.doc")
def normalized_text(spark, sf_dir):
    return transcripts(spark, sf_dir).select("doc", F.md5(F.nullif(X.normalize_text(F.col("text")), F.lit("")).cast("binary")).alias("normal"))


@query("WITH p AS (SELECT page_id, string_split(replace(html, '</', '*|'), '*|') AS parts FROM pages) SELECT page_id, len(parts) AS segments, length(parts[1]) AS first_length, md5(array_to_string(list_transform(parts, lambda x: length(x) || ':' || x), '')) AS pieces FROM p")
def boundary_split(spark, sf_dir):
    parts = X.boundary_segments(F.replace("html", F.lit("</"), F.lit("*|")))
    rows = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    pieces = F.array_join(F.transform("parts", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")
    return rows.select("page_id", F.size("parts").cast("long").alias("segments"), F.length(F.get("parts", 0)).cast("long").alias("first_length"), F.md5(pieces.cast("binary")).alias("pieces"))


def angle_tagged(docs: DataFrame) -> DataFrame:
    """(doc, text) of documents with a token: every eleventh token in angle-bracket tags."""
    tagged = lambda t, p: F.when(p % 11 == 3, F.concat(F.lit("<PERSON>"), t, F.lit("</PERSON>"))).when(p % 11 == 7, F.concat(F.lit("<DATE>"), t)).otherwise(t)
    return docs.where(X.has_token(F.col("text"))).select("doc", F.array_join(F.transform(X.split_tokens(F.col("text")), tagged), " ").alias("text"))


@query(f"WITH {TOKENS} SELECT doc, md5(string_agg(CASE WHEN pos % 11 = 3 THEN '[PERSON]' || tok || '[/PERSON]' WHEN pos % 11 = 7 THEN '[DATE]' || tok ELSE tok END, ' ' ORDER BY pos)) AS corrected FROM t GROUP BY doc")
def tag_correction(spark, sf_dir):
    return angle_tagged(dealt(transcripts(spark, sf_dir), "doc")).select("doc", F.md5(X.correct_tags(F.col("text")).cast("binary")).alias("corrected"))


@query(f"WITH {TOKENS} SELECT doc, md5(string_agg(CASE WHEN pos % 11 = 3 THEN '[PERSON]' || lower(tok) || '[/PERSON]' WHEN pos % 11 = 7 THEN '[DATE]' || lower(tok) ELSE lower(tok) END, ' ' ORDER BY pos)) AS lowered FROM t GROUP BY doc")
def lowered_text(spark, sf_dir):
    return angle_tagged(dealt(transcripts(spark, sf_dir), "doc")).select("doc", F.md5(X.lower_keeping_tags(X.correct_tags(F.col("text"))).cast("binary")).alias("lowered"))


@query()
def tag_repair(spark, sf_dir):
    """Unpaired tags of damaged transcripts taken away; tests hold it against goldens and a second implementation."""
    rows = angle_tagged(dealt(transcripts(spark, sf_dir), "doc"))
    return tags.repair_tags(rows.select("doc", X.correct_tags(F.col("text")).alias("repaired")), "repaired")


# ---- windows ---------------------------------------------------------------------------------------------------------


@query(f"WITH {MEMBERS} SELECT doc, k, side, count(*) AS n, sum(idx) AS idx_sum FROM m GROUP BY doc, k, side")
def context_windows(spark, sf_dir):
    members = windows.window_members(event_words(spark, sf_dir), LEFT, MID, RIGHT)
    return members.groupBy("doc", "k", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


@query(f"""WITH {MEMBERS} SELECT doc, k, side, count(*) AS n FROM m WHERE CASE side WHEN 'left' THEN "end" > greatest(0, k * {MID} - {LEFT}) AND "end" <= k * {MID} WHEN 'mid' THEN "end" > k * {MID} AND "end" <= (k + 1) * {MID} ELSE "end" > (k + 1) * {MID} AND "end" <= (k + 1) * {MID} + {RIGHT} END GROUP BY doc, k, side""")
def strict_windows(spark, sf_dir):
    members = windows.window_members(event_words(spark, sf_dir), LEFT, MID, RIGHT, strict=True)
    return members.groupBy("doc", "k", "side").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS}, tot AS (SELECT doc, arg_max(\"end\", idx) AS total FROM w GROUP BY doc), ks AS (SELECT doc, unnest(generate_series(0, (total - 1) // {6 * HOUR})) AS k FROM tot) SELECT doc, k, count(*) AS n FROM ks JOIN w USING (doc) WHERE start >= greatest(0, k * {6 * HOUR} - {15 * HOUR}) AND start < (k + 1) * {6 * HOUR} + {20 * HOUR} GROUP BY doc, k")
def long_context_windows(spark, sf_dir):
    members = windows.window_members(event_words(spark, sf_dir), 15 * HOUR, 6 * HOUR, 20 * HOUR)
    return members.groupBy("doc", "k").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SECTIONS} SELECT * FROM sec")
def window_sections(spark, sf_dir):
    return windows.sections(windows.window_members(event_words(spark, sf_dir), LEFT, MID, RIGHT))


def event_chunks(spark, sf_dir) -> DataFrame:
    return windows.chunks(window_sections(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT doc, k, CASE WHEN coalesce(ls, 0) <> 0 THEN ls ELSE ms END AS start_time, CASE WHEN coalesce(re, 0) <> 0 THEN re ELSE me END AS end_time FROM ch")
def window_fallback(spark, sf_dir):
    c = F.col
    return event_chunks(spark, sf_dir).select("doc", "k", X.or_else(c("left.start_time"), c("mid.start_time")).alias("start_time"), X.or_else(c("right.end_time"), c("mid.end_time")).alias("end_time"))


@query(f"WITH {CHUNKS} SELECT doc, k, row_number() OVER (ORDER BY doc, k) - 1 AS global_chunk_number FROM ch")
def chunk_numbering(spark, sf_dir):
    return windows.number_chunks(event_chunks(spark, sf_dir)).select("doc", "k", "global_chunk_number")


@query(f"WITH {EVENTS}, x AS (SELECT doc, idx, CAST(start % 60000 AS DOUBLE) / 1000 AS s FROM w) SELECT doc, idx, printf('<|%.2f|>', round(floor(s / CAST(0.02 AS DOUBLE)) * CAST(0.02 AS DOUBLE), 2)) AS token FROM x")
def time_tokens(spark, sf_dir):
    return event_words(spark, sf_dir).select("doc", "idx", E.time_token(E.round_down_02((F.col("start") % 60000) / F.lit(1000))).alias("token"))


def _offset_sql(ms: str) -> str:
    return f"round(floor((CAST({ms} - st AS DOUBLE) / 1000) / CAST(0.02 AS DOUBLE)) * CAST(0.02 AS DOUBLE), 2)"


def _token_sql(ms: str) -> str:
    return f"printf('<|%.2f|>', {_offset_sql(ms)})"


def chunk_texts(spark, sf_dir) -> DataFrame:
    """Chunks with st and en, their own begin and end, and text, the words of their three sections between bars."""
    c = F.col
    members = windows.window_members(event_words(spark, sf_dir), LEFT, MID, RIGHT)
    side = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("side") == s, F.struct("idx", "word")))), lambda x: x["word"]), " ")
    texts = members.groupBy("doc", "k").agg(F.concat_ws("|", side("left"), side("mid"), side("right")).alias("text"))
    rows = windows.chunks(windows.sections(members)).join(texts, ["doc", "k"])
    return rows.withColumns({"st": X.or_else(c("left.start_time"), c("mid.start_time")), "en": X.or_else(c("right.end_time"), c("mid.end_time"))})


TEXTS = f"""{CHUNKS}, x AS (SELECT doc, k, coalesce(string_agg(word, ' ' ORDER BY idx) FILTER (WHERE side = 'left'), '') AS lt, coalesce(string_agg(word, ' ' ORDER BY idx) FILTER (WHERE side = 'mid'), '') AS mt, coalesce(string_agg(word, ' ' ORDER BY idx) FILTER (WHERE side = 'right'), '') AS rt FROM m GROUP BY doc, k),
f AS (SELECT ch.*, lt, mt, rt, CASE WHEN coalesce(ls, 0) <> 0 THEN ls ELSE ms END AS st, CASE WHEN coalesce(re, 0) <> 0 THEN re ELSE me END AS en FROM ch JOIN x USING (doc, k))"""


@query(f"""WITH {TEXTS}, g AS (SELECT doc, k, lt, mt, rt, {_token_sql("ms")} AS mst, {_token_sql("me")} AS met, CASE WHEN coalesce(le, 0) <> 0 AND {_offset_sql("le")} <> 0 THEN {_token_sql("le")} ELSE '<|0.00|>' END AS let,
  CASE WHEN coalesce(rs, 0) <> 0 THEN {_token_sql("rs")} ELSE {_token_sql("me")} END AS rst, CASE WHEN coalesce(re, 0) <> 0 THEN {_token_sql("re")} ELSE {_token_sql("me")} END AS ret FROM f)
SELECT doc, k, '<|left|><|0.00|>' || lt || ' ' || let || let || '<|mid|><|startoftranscript|><|notimestamps|>' || mst || mst || mt || ' ' || met || met || '<|endoftext|><|right|>' || rst || rst || rt || ret || ret AS encoded FROM g""")
def windowed_rows(spark, sf_dir):
    c = F.col
    return chunk_texts(spark, sf_dir).select("doc", "k", E.windowed_text(c("text"), c("st"), c("left.end_time"), c("mid.start_time"), c("mid.end_time"), c("right.start_time"), c("right.end_time")).alias("encoded"))


@query(f"""WITH {TEXTS}, g AS (SELECT doc, k, lt, mt, rt, {_token_sql("ms")} AS mst, coalesce(rs, 0) <> 0 AND {_offset_sql("rs")} <> 0 AS has_right, {_token_sql("rs")} AS rst, {_token_sql("en")} AS ent FROM f)
SELECT doc, k, '<|0.00|>' || replace(trim(lt || ' ' || CASE WHEN lt <> '' THEN mst || mst || mt ELSE mt END || CASE WHEN has_right THEN rst || rst ELSE '' END || ' ' || rt), '  ', ' ') || ent || ent AS encoded FROM g""")
def plain_rows(spark, sf_dir):
    c = F.col
    return chunk_texts(spark, sf_dir).select("doc", "k", E.plain_text(c("text"), c("st"), c("en"), c("mid.start_time"), c("right.start_time")).alias("encoded"))


# ---- selection -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_docs(spark, sf_dir):
    listed = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return selection.of_listed(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), listed.unionByName(listed), "doc_id", "doc_id")


@query("SELECT l.doc_id, d.n_chars FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) l JOIN documents d ON d.doc_id = l.doc_id")
def selected_ids(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    ids = labels.select("doc_id").unionByName(labels.where("toxic = 1").select("doc_id"))
    return selection.select_ids(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ids, "doc_id", "doc_id", strict=True)


@query("SELECT doc_id FROM documents WHERE n_chars > 2000 INTERSECT SELECT doc_id FROM labels")
def split_leakage(spark, sf_dir):
    return selection.leaked(table(spark, sf_dir, "documents").where("n_chars > 2000").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return selection.last_wins(events, "user_id", "event_id").select("user_id", "event_type", "value")


@query("SELECT a.doc_id, CASE WHEN a.n_chars % 4 <> 0 THEN a.doc_id ELSE a.doc_id // 30 END AS used, b.n_chars FROM documents a JOIN documents b ON b.doc_id = CASE WHEN a.n_chars % 4 <> 0 THEN a.doc_id ELSE a.doc_id // 30 END")
def fallback_row(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") % 4 != 0).alias("valid"))
    return selection.substitute(docs, "doc_id", "valid", 30)


@query("SELECT doc_id FROM documents WHERE starts_with(CAST(doc_id AS VARCHAR), '1') OR starts_with(CAST(doc_id AS VARCHAR), '2')")
def id_prefixes(spark, sf_dir):
    return selection.id_prefix(table(spark, sf_dir, "documents"), "doc_id", "12").select("doc_id")


# ---- entities --------------------------------------------------------------------------------------------------------


def order_spans(spark, sf_dir, modulus: int) -> DataFrame:
    """Entities of a customer from orders: intervals of days."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == modulus)
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    label = F.when(F.col("o_orderstatus") == "O", "TIME").otherwise("DATE")
    return orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("val"), F.lit("").alias("normalized_val"), label.alias("label"), start.alias("puncted_start"), (start + 30 + (F.col("o_orderkey") % 60)).cast("int").alias("puncted_end"), start.alias("nstart"), start.alias("nend"), F.col("o_orderkey").alias("ord"))


_SPANS = "o AS (SELECT o_custkey AS doc, o_orderpriority AS val, CASE WHEN o_orderstatus = 'O' THEN 'TIME' ELSE 'DATE' END AS label, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS s, o_orderkey AS ord FROM orders), i AS (SELECT *, s + 30 + ord % 60 AS e FROM o), a AS (SELECT * FROM i WHERE ord % 2 = 0), b AS (SELECT * FROM i WHERE ord % 2 = 1), x AS (SELECT a.doc, a.ord AS ao, b.ord AS bo, CASE WHEN b.e - b.s > a.e - a.s THEN b.val ELSE a.val END AS val, CASE WHEN b.e - b.s > a.e - a.s THEN b.s ELSE a.s END AS s, CASE WHEN b.e - b.s > a.e - a.s THEN b.e ELSE a.e END AS e FROM a JOIN b ON a.doc = b.doc AND a.label = 'TIME' AND b.label = 'TIME' AND a.s < b.e AND b.s < a.e)"


@query(f"WITH {_SPANS} SELECT doc, val, 'TIME' AS label, s AS puncted_start, e AS puncted_end, 0 AS kind FROM x UNION ALL SELECT doc, val, label, s, e, 1 FROM a WHERE ord NOT IN (SELECT ao FROM x) UNION ALL SELECT doc, val, label, s, e, 2 FROM b WHERE ord NOT IN (SELECT bo FROM x)")
def interval_merge(spark, sf_dir):
    merged = entities.merge_overlapping(order_spans(spark, sf_dir, 0), order_spans(spark, sf_dir, 1))
    return merged.select("doc", "val", "label", F.col("puncted_start").cast("long").alias("puncted_start"), F.col("puncted_end").cast("long").alias("puncted_end"), F.col("rank.kind").alias("kind"))


@query(f"""WITH {RULED}, n AS (SELECT *, translate(tok, '.,-', '') AS bare FROM r), g AS (SELECT doc, pos, tok, CASE WHEN label IS NOT NULL THEN label
 WHEN regexp_matches(tok, '[0-9]') AND length(bare) > 0 AND (regexp_matches(bare, '^\\p{{Nd}}+$') OR (length(bare) > 1 AND length(regexp_replace(bare, '[^\\p{{Nd}}]', '', 'g')) >= 0.4 * length(bare))) THEN 'NUMERIC' END AS tag FROM n)
SELECT doc, md5(string_agg(CASE WHEN tag IS NULL THEN tok ELSE '<' || tag || '>' || tok || '</' || tag || '>' END, ' ' ORDER BY pos)) AS tagged, count(tag) AS n_entities FROM g GROUP BY doc""")
def tag_embed(spark, sf_dir):
    rows = spoken(doc_tokens(spark, sf_dir))
    found = Scratch(spark, "tokens").keep(entities.tag_all(rows), "entities")
    tagged = entities.embed_tags(rows, found)
    texts = tagged.groupBy("doc").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tagged"))), lambda x: x["tagged"]), " ").cast("binary")).alias("tagged"))
    counts = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return texts.join(counts, "doc", "left").select("doc", "tagged", F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"))


# ---- error rates and metrics -----------------------------------------------------------------------------------------


def _coded_sql(items: str, known: str) -> str:
    """DuckDB's levenshtein counts bytes: items of a list as one byte each, 126 kinds at most."""
    return f"array_to_string(list_transform({items}, lambda x: chr(CAST(list_position({known}, x) AS INTEGER))), '')"


_CER = f"levenshtein({_coded_sql('s', 'ws')}, {_coded_sql('t', 'ws')})"


@query(f"""WITH c AS (SELECT item_id, string_split(text, '') AS cs FROM benchmark), p AS (SELECT x.item_id AS a, y.item_id AS b, x.cs AS s, y.cs AS t, list_distinct(list_concat(x.cs, y.cs)) AS ws FROM c x JOIN c y ON y.item_id = x.item_id + 1 OR y.item_id = x.item_id + 2)
SELECT a, b, {_CER} AS errors, round(CAST({_CER} AS DOUBLE) / len(s), 9) AS cer FROM p""")
def cer_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    x = items.select(F.col("item_id").alias("a"), F.col("text").alias("s"), F.explode(F.array(F.col("item_id") + 1, F.col("item_id") + 2)).alias("b"))
    rows = x.join(items.select(F.col("item_id").alias("b"), F.col("text").alias("t")), "b").withColumn("errors", S.char_distance(F.col("s"), F.col("t")))
    return rows.select("a", "b", F.col("errors").cast("long").alias("errors"), F.round(F.col("errors").cast("double") / F.length("s"), 9).alias("cer"))


def item_pairs(spark, sf_dir) -> DataFrame:
    """(doc, r, h): the words of test items and of their damaged copies."""
    rows = damaged(tokens(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), "text")))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    return rows.groupBy("doc").agg(side("ref").alias("r"), F.filter(side("hyp"), lambda t: t != "*").alias("h"))


_ITEMS = DAMAGED.replace("SELECT doc_id AS doc, text FROM documents", "SELECT item_id AS doc, text FROM benchmark") + ", u AS (SELECT doc, list(ref ORDER BY pos) AS r, list(hyp ORDER BY pos) FILTER (WHERE hyp <> '*') AS h FROM dm GROUP BY doc), v AS (SELECT doc, r, h, list_distinct(list_concat(r, h)) AS ws FROM u)"
_WER = f"levenshtein({_coded_sql('r', 'ws')}, {_coded_sql('h', 'ws')})"


@query(f"WITH {_ITEMS} SELECT doc, {_WER} AS errors, len(r) AS words FROM v")
def wer_pairs(spark, sf_dir):
    return item_pairs(spark, sf_dir).select("doc", S.word_distance(F.col("r"), F.col("h")).cast("long").alias("errors"), F.size("r").cast("long").alias("words"))


@query(f"WITH {_ITEMS} SELECT doc, {_WER} AS errors FROM v")
def align_ops(spark, sf_dir):
    """Errors counted off the alignment, which must be a least-cost one."""
    rows = item_pairs(spark, sf_dir).select("doc", S.align(F.array_join("r", " "), F.array_join("h", " ")).alias("tokens"))
    return rows.select("doc", F.size(F.filter("tokens", lambda t: t["op"] != "equal")).cast("long").alias("errors"))


@query("WITH p AS (SELECT p_partkey, p_name, p_type, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS score, round(jaro_winkler_similarity(w[1], w[2]), 6) AS words FROM p")
def jw_labels(spark, sf_dir):
    part, w = table(spark, sf_dir, "part"), F.split("p_name", " ", -1)
    return part.select("p_partkey", F.round(S.jaro_winkler("p_name", "p_type"), 6).alias("score"), F.round(S.jaro_winkler(F.get(w, 0), F.get(w, 1)), 6).alias("words"))


_RATES = "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0 END AS accuracy"
_CASE = f"{DAMAGED}, b AS (SELECT doc, regexp_replace(ref, '[.!;,?]$', '') AS r, regexp_replace(hyp, '[.!;,?]$', '') AS h FROM dm WHERE hyp <> '*' AND ref <> '#')"


@query(f"WITH {_CASE}, c AS (SELECT doc, count(*) FILTER (WHERE r = h) AS tp, CAST(0 AS BIGINT) AS fp, count(*) FILTER (WHERE lower(r) = lower(h) AND r <> h) AS fn, count(*) FILTER (WHERE lower(r) <> lower(h)) AS tn FROM b GROUP BY doc) SELECT *, {_RATES} FROM c")
def cap_metrics(spark, sf_dir):
    return evaluation.rates(evaluation.case_counts(damaged(doc_tokens(spark, sf_dir)), "doc"))


_MARKS = f"{DAMAGED}, k AS (SELECT doc, CASE WHEN right(ref, 1) IN ('.', '!', ';', ',', '?') THEN right(ref, 1) END AS r, CASE WHEN right(hyp, 1) IN ('.', '!', ';', ',', '?') THEN right(hyp, 1) END AS h FROM dm WHERE hyp <> '*' AND ref <> '#')"


@query(f"WITH {_MARKS}, c AS (SELECT coalesce(r, h) AS mark, count(*) FILTER (WHERE r = h) AS tp, count(*) FILTER (WHERE r IS NULL) AS fp, count(*) FILTER (WHERE r IS NOT NULL AND r IS DISTINCT FROM h) AS fn, CAST(0 AS BIGINT) AS tn FROM k WHERE coalesce(r, h) IS NOT NULL GROUP BY 1) SELECT *, {_RATES} FROM c")
def punct_metrics(spark, sf_dir):
    return evaluation.rates(evaluation.mark_counts(damaged(tokens(transcripts(spark, sf_dir)))))


def bio_rows(rows: DataFrame, shift: int = 0) -> DataFrame:
    """(doc, pos, bio): a three-word PERSON at every seventeenth word, a DATE right behind each second one; with shift, one in four of another label."""
    p, n = F.col("pos") % 17, F.expr("pos div 17")
    person = F.when((n % 4 == 0) & (F.lit(shift) > 0), "ORG").otherwise("PERSON")
    bio = F.when(p == 4, F.concat(F.lit("B-"), person)).when(p.isin(5, 6), F.concat(F.lit("I-"), person)).when((p == 7) & (n % 2 == 1), "B-DATE").when((p == 8) & (n % 2 == 1) & (n % 3 > 0), F.lit("I-DATE")).otherwise("O")
    return rows.select("doc", "pos", bio.alias("bio"))


def _bio_sql(shift: int) -> str:
    person = "CASE WHEN n % 4 = 0 THEN 'ORG' ELSE 'PERSON' END" if shift else "'PERSON'"
    return f"SELECT doc, pos, CASE WHEN p = 4 THEN 'B-' || {person} WHEN p IN (5, 6) THEN 'I-' || {person} WHEN p = 7 AND n % 2 = 1 THEN 'B-DATE' WHEN p = 8 AND n % 2 = 1 AND n % 3 > 0 THEN 'I-DATE' ELSE 'O' END AS bio FROM (SELECT doc, pos, pos % 17 AS p, pos // 17 AS n FROM t)"


def _spans_sql(name: str, source: str) -> str:
    return f"{name}0 AS ({source}), {name}1 AS (SELECT *, substr(bio, 3) AS label, lag(bio) OVER (PARTITION BY doc ORDER BY pos) AS before FROM {name}0), {name}2 AS (SELECT *, sum(CASE WHEN bio LIKE 'B-%' OR (bio LIKE 'I-%' AND (before IS NULL OR before = 'O' OR substr(before, 3) <> label)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS span FROM {name}1), {name} AS (SELECT doc, label, min(pos) AS start, count(*) AS length FROM {name}2 WHERE bio <> 'O' GROUP BY doc, span, label)"


@query(f"WITH {TOKENS}, {_spans_sql('s', _bio_sql(0))} SELECT doc, label, start, length FROM s")
def bio_chunks(spark, sf_dir):
    return evaluation.bio_spans(bio_rows(doc_tokens(spark, sf_dir)))


@query(f"WITH {TOKENS}, {_spans_sql('r', _bio_sql(0))}, {_spans_sql('h', _bio_sql(1))}, j AS (SELECT coalesce(r.label, h.label) AS label, r.doc IS NOT NULL AS inr, h.doc IS NOT NULL AS inh FROM r FULL JOIN h ON r.doc = h.doc AND r.label = h.label AND r.start = h.start AND r.length = h.length), c AS (SELECT label, count(*) FILTER (WHERE inr AND inh) AS tp, count(*) FILTER (WHERE NOT inr) AS fp, count(*) FILTER (WHERE NOT inh) AS fn, CAST(0 AS BIGINT) AS tn FROM j GROUP BY label) SELECT *, {_RATES} FROM c")
def ner_f1(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir)
    return evaluation.rates(evaluation.span_counts(evaluation.bio_spans(bio_rows(rows)), evaluation.bio_spans(bio_rows(rows, 1)), "label"))


def starred(rows: DataFrame) -> DataFrame:
    """(doc, pos, hyp): words 40 to 75 of each hundred are missing, and all of the first 35."""
    p = F.col("pos")
    return rows.select("doc", "pos", F.when((p < 35) | ((p % 100 >= 40) & (p % 100 < 75)), "*").otherwise(F.col("tok")).alias("hyp"))


@query(f"WITH {TOKENS}, x AS (SELECT doc, pos FROM t WHERE pos < 35 OR (pos % 100 >= 40 AND pos % 100 < 75) OR tok = '*'), y AS (SELECT doc, pos, pos - row_number() OVER (PARTITION BY doc ORDER BY pos) AS g FROM x) SELECT doc, min(pos) AS start, count(*) AS length FROM y GROUP BY doc, g HAVING count(*) >= 30")
def deletion_runs(spark, sf_dir):
    return evaluation.deletion_runs(starred(doc_tokens(spark, sf_dir)))


@query(f"WITH {TOKENS}, x AS (SELECT doc, pos FROM t WHERE pos < 35 OR (pos % 100 >= 40 AND pos % 100 < 75) OR tok = '*'), y AS (SELECT doc, pos, pos - row_number() OVER (PARTITION BY doc ORDER BY pos) AS g FROM x), z AS (SELECT doc, min(pos) AS start FROM y GROUP BY doc, g HAVING count(*) >= 30), f AS (SELECT doc, min(start) AS start FROM z GROUP BY doc), n AS (SELECT doc, count(*) AS n FROM t GROUP BY doc) SELECT n.doc, coalesce(start, -1) AS first_run, CASE WHEN coalesce(start, -1) > 0 THEN start ELSE n END AS kept FROM n LEFT JOIN f USING (doc)")
def deletion_cut(spark, sf_dir):
    rows = starred(doc_tokens(spark, sf_dir)).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hyp"))), lambda x: x["hyp"]).alias("hyp"))
    at = evaluation.deletion_start(F.col("hyp"))
    return rows.select("doc", at.cast("long").alias("first_run"), F.when(at > 0, at).otherwise(F.size("hyp")).cast("long").alias("kept"))


@query(f"WITH {_CASE}, c AS (SELECT doc, count(*) FILTER (WHERE r = h) AS tp, count(*) FILTER (WHERE lower(r) = lower(h) AND r <> h) AS fn, count(*) AS words FROM b GROUP BY doc), s AS (SELECT doc, sum(tp) AS tp, sum(fn) AS fn, sum(words) AS words, CAST(grouping(doc) AS INTEGER) AS is_total FROM c GROUP BY ROLLUP (doc)) SELECT doc, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(words AS BIGINT) AS words, is_total, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS case_accuracy FROM s")
def report_rollup(spark, sf_dir):
    counts = evaluation.case_counts(damaged(doc_tokens(spark, sf_dir)), "doc").withColumn("words", F.col("tp") + F.col("fn") + F.col("tn"))
    return evaluation.rolled_up(counts, "doc", "tp", "fn", "words").withColumn("case_accuracy", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'DATE' ELSE 'MONEY' END AS label, p_name AS r, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS h FROM part)
SELECT label, count(*) AS pairs, round(avg(CASE WHEN label = 'MONEY' THEN CAST(levenshtein(r, h) AS DOUBLE) / length(r) WHEN h = '' THEN 0 ELSE jaro_winkler_similarity(r, h) END), 6) AS mean FROM p GROUP BY label""")
def label_stats(spark, sf_dir):
    key = F.col("p_partkey")
    pairs = table(spark, sf_dir, "part").select(F.when(key % 3 == 0, "PERSON").when(key % 3 == 1, "DATE").otherwise("MONEY").alias("label"), F.col("p_name").alias("ref"), F.when(key % 7 == 0, "").otherwise(F.col("p_type")).alias("hyp"))
    return evaluation.label_similarity(pairs).select("label", "pairs", F.round(F.col("total") / F.col("pairs"), 6).alias("mean"))


@query()
def evaluation_report(spark, sf_dir):
    """The whole evaluation of damaged transcripts against the transcripts, word errors per document."""
    from .plans.corpus import evaluate

    docs = dealt(transcripts(spark, sf_dir).where("text is not null"), "doc")
    kept = F.filter(F.transform(X.split_tokens(F.col("text")), damage), lambda t: t != "*")
    hyps = docs.select("doc", kept.alias("kept")).where("size(kept) > 0").select("doc", F.array_join("kept", " ").alias("text"))
    return evaluate(docs, hyps, "doc")["errors"]


# ---- numeric kernels -------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT vec_id, label % 64 AS target, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, -(v[target + 1] - list_max(v) - ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))) AS nll, CAST(vec_id % 3 <> 0 AS INTEGER) AS m FROM e) SELECT round((sum(nll * m) + sum(nll * (1 - m))) / sum(m), 6) AS loss, round((sum(nll * m) + 0.5 * sum(nll * (1 - m))) / sum(m), 6) AS penalised, count(*) AS n FROM n")
def masked_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((-E.log_softmax_at(F.col("embedding"), F.col("label") % 64)).alias("nll"), (F.col("vec_id") % 3 != 0).alias("mask"))
    nll, mask = F.col("nll"), F.col("mask").cast("int")
    return rows.agg(F.round(E.masked_loss(nll, mask), 6).alias("loss"), F.round(E.masked_loss(nll, mask, 0.5), 6).alias("penalised"), F.count(F.lit(1)).alias("n"))


@query("WITH d AS (SELECT doc_id, list_transform(generate_series(1, CAST(n_chars % 12 + 1 AS BIGINT)), lambda i: CAST((doc_id * 31 + i * 7) % 1000 AS INTEGER)) AS ids FROM documents) SELECT doc_id, list_concat(ids, list_transform(generate_series(1, 12 - len(ids)), lambda i: -100)) AS labels, list_concat([50258], ids[1:len(ids) - 1]) AS decoder_input_ids FROM d")
def pad_shift(spark, sf_dir):
    key = F.col("doc_id")
    ids = F.transform(F.sequence(F.lit(1), F.col("n_chars") % 12 + 1), lambda i: ((key * 31 + i * 7) % 1000).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", E.pad_labels(F.col("ids"), F.lit(12)).alias("labels"), E.shift_right(F.col("ids"), 50258).alias("decoder_input_ids"))


@query("WITH s AS (SELECT event_id, event_id % 6000 AS step FROM events) SELECT event_id, step, round(CASE WHEN step < 1250 THEN step / 1250.0 * 0.0001 ELSE 0.0001 * (1 - least((step - 1250) / 3750.0, 1)) END, 12) AS rate FROM s")
def lr_schedule(spark, sf_dir):
    """The rate at every event, taken as a log of training steps that begins anew every 6000."""
    steps = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6000).alias("step"))
    return steps.select("event_id", "step", F.round(E.learning_rate(F.col("step"), 1e-4, 1250, 5000), 12).alias("rate"))


@query("WITH d AS (SELECT doc_id, list_transform(generate_series(1, 10), lambda i: CASE WHEN i = 2 + doc_id % 3 THEN 51908 WHEN i = 6 + doc_id % 4 AND doc_id % 5 <> 0 THEN 51907 ELSE i END) AS ids FROM documents), p AS (SELECT doc_id, ids, list_position(ids, 51908) AS a, coalesce(list_position(ids, 51907), 0) AS b FROM d) SELECT doc_id, len(list_filter(generate_series(1, 10), lambda i: i >= a AND i < b)) AS n_mid FROM p")
def mid_masks(spark, sf_dir):
    key = F.col("doc_id")
    ids = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.when(i == 2 + key % 3, E.MID_ID).when((i == 6 + key % 4) & (key % 5 != 0), E.RIGHT_ID).otherwise(i))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.size(F.filter(E.mid_mask(F.col("ids")), lambda x: x)).cast("long").alias("n_mid"))


# ---- streams ---------------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), k AS (SELECT user_id, us, us // 86400000000 AS k, us % 86400000000 AS r FROM e), m AS (SELECT user_id, us, k, 'mid' AS side FROM k UNION ALL SELECT user_id, us, k + 1, 'left' FROM k WHERE r >= 64800000000 UNION ALL SELECT user_id, us, k - 1, 'right' FROM k WHERE r < 21600000000 AND k >= 1) SELECT user_id, k, side, count(*) AS n FROM m GROUP BY user_id, k, side")
def stream_windows(spark, sf_dir):
    """The plan of the streaming operator, run over the finished table; tests run it as a stream."""
    return stream_sections(table(spark, sf_dir, "events"), left_s=21600, mid_s=86400, right_s=21600).select("user_id", "k", "side", "n")


EPOCH_WORDS = f"""w AS (SELECT user_id AS doc, event_id AS idx, event_type AS word, epoch_us(ts) // 1000 AS start, epoch_us(ts) // 1000 + 500 AS "end" FROM events),
m AS (SELECT doc, idx, word, start, "end", start // {MID} AS k, 'mid' AS side FROM w UNION ALL SELECT doc, idx, word, start, "end", start // {MID} + 1, 'left' FROM w WHERE start % {MID} >= {MID - LEFT} UNION ALL SELECT doc, idx, word, start, "end", start // {MID} - 1, 'right' FROM w WHERE start % {MID} < {RIGHT})"""


@query(f"""WITH {EPOCH_WORDS}, t AS (SELECT doc, k, string_agg(word, ' ' ORDER BY idx) FILTER (WHERE side = 'left') AS l, string_agg(word, ' ' ORDER BY idx) FILTER (WHERE side = 'mid') AS m, string_agg(word, ' ' ORDER BY idx) FILTER (WHERE side = 'right') AS r,
 arg_min(start, idx) FILTER (WHERE side = 'mid') AS mid_start, arg_max("end", idx) FILTER (WHERE side = 'mid') AS mid_end, count(*) FILTER (WHERE side = 'left') AS n_left FROM m GROUP BY doc, k)
SELECT doc, k, coalesce(l, '') || '|' || m || '|' || coalesce(r, '') AS text, mid_start, mid_end, n_left FROM t WHERE m IS NOT NULL""")
def streamed_chunks(spark, sf_dir):
    """Whole chunks of all events, by the stateful operator over a replayed stream."""
    millis = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.lit(0).cast("long").alias("origin"), F.col("event_id").cast("long").alias("idx"), F.col("event_type").alias("word"), millis.alias("start"), (millis + 500).alias("end"))
    chunks = finished_chunks(words, left=LEFT, mid=MID, right=RIGHT)
    return chunks.select("doc", "k", "text", F.col("mid.start_time").alias("mid_start"), F.col("mid.end_time").alias("mid_end"), F.coalesce(F.size("left.tokens"), F.lit(0)).cast("long").alias("n_left"))


from . import queries_core  # noqa: E402, F401  registers more
