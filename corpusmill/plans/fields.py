"""Queries of the smaller functions, over documents, conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import medical as md
from ..functions import misc
from ..functions import questions as qs
from ..functions import sources as src
from ..functions import text as tx
from ..operators import chunking as ch
from ..operators import dataset as ds
from ..operators import enrich
from ..operators import evaluation as ev
from .base import query, table
from .search import NAMED, file_name

#: SQL: white space as the engine takes it, for {x}.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def normal(x: str) -> str:
    """SQL: text with single spaces and none at its ends."""
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


HASH16 = "substr(sha256({x}), 1, 16)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""WITH n AS (SELECT doc_id, text, {normal("text")} AS t, {NAMED} AS name FROM documents)
SELECT doc_id, {HASH16.format(x="t")} AS hash, CAST(length(t) AS BIGINT) AS chars, round(length(t)::DOUBLE / greatest(1, length(text)), 6) AS density,
CASE WHEN len(string_split(t, ' ')) >= 120 THEN 'hard' WHEN len(string_split(t, ' ')) >= 60 THEN 'medium' ELSE 'easy' END AS difficulty,
md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug_md5,
CASE WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.md' THEN 'markdown' ELSE 'default' END AS kind FROM n""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts with hash and density, difficulty, slug and source kind (SF7, SF8, SF10, SF12, SF18, SF53)."""
    t = F.col("text")
    plain = tx.normalize_space(t)
    return docs(spark, sf_dir).select("doc_id", misc.text_hash(t).alias("hash"), F.length(plain).cast("long").alias("chars"), F.round(tx.density(t, t), 6).alias("density"), tx.difficulty(F.size(F.split(plain, " "))).alias("difficulty"), F.md5(tx.slugify(t)).alias("slug_md5"), tx.source_kind(file_name()).alias("kind"))


@query(r"""WITH k AS (SELECT doc_id, text, CASE WHEN instr(lower(text), 'thin') > 0 THEN instr(lower(text), 'thin') ELSE nullif(instr(lower(text), 'ver'), 0) END AS place, CASE WHEN instr(lower(text), 'thin') > 0 THEN 4 ELSE 3 END AS n FROM documents),
c AS (SELECT doc_id, substr(text, CAST(greatest(1, place - 60) AS BIGINT), CAST(place + n + 60 - greatest(1, place - 60) AS BIGINT)) AS cut FROM k)
SELECT doc_id, coalesce(substr(regexp_replace(cut, '^\s+|\s+$', '', 'g'), 1, 220), '') AS phrase FROM c""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text around the first keyword that occurs (SF19)."""
    return docs(spark, sf_dir).select("doc_id", tx.evidence_phrase(F.col("text"), ["thin", "ver"]).alias("phrase"))


@query(f"""WITH n AS (SELECT doc_id, source, {NAMED} AS name FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN source || ' page ' || (doc_id % 4) ELSE source END AS label, CASE WHEN doc_id % 5 = 0 THEN 'Named' ELSE source END AS canonical,
lower(concat_ws(' ', source, name)) AS flat, CASE WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.csv' THEN 'reference_csv' ELSE 'html' END AS kind,
CASE WHEN doc_id % 3 = 2 THEN name ELSE source END AS bare, CASE WHEN doc_id % 7 = 0 THEN 'told' WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.csv' THEN 'csv' ELSE 'html' END AS expected FROM n""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a citation shows of its source (SF22-SF27, SU6, PF17, PF24)."""
    name, i = file_name(), F.col("doc_id")
    label = src.readable_label(name)
    told = F.when(i % 7 == 0, "told")
    return docs(spark, sf_dir).select(
        "doc_id",
        src.display_label(label, i % 4).alias("label"),
        misc.canonical_label(name, F.when(i % 5 == 0, " Named ")).alias("canonical"),
        misc.flat_source(F.col("source"), name, F.lit(None).cast("string")).alias("flat"),
        src.source_type(name).alias("kind"),
        ev.label_of(name).alias("bare"),
        misc.expected_source_type(told, F.array().cast("array<string>"), F.array(name)).alias("expected"),
    )


@query(f"""WITH c AS (SELECT conv_id, string_agg('[Source: ' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS ctx FROM conversations GROUP BY conv_id)
SELECT conv_id, {HASH16.format(x="ctx")} AS context, {HASH16.format(x="CASE WHEN conv_id % 2 = 0 THEN 'Conversation so far:' || chr(10) || 'h' || chr(10) || chr(10) || ctx ELSE ctx END")} AS whole FROM c""")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts from results in rank order, alone and after a history (SF28, SF49)."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("rank"), F.col("role").alias("label"), F.col("text").alias("content"))).alias("r"))
    ctx = misc.context_of(F.col("r"))
    return rows.select("conv_id", tx.content_hash(ctx).alias("context"), tx.content_hash(misc.full_context(F.when(F.col("conv_id") % 2 == 0, "h"), ctx)).alias("whole"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN floor(epoch(ts)) ELSE floor(epoch(ts)) * 1000 / 1000 END AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS run_time,
printf('%+.1f%%', (floor(value) - 7) / 7 * 100) AS change, lower(event_type) || '_at_k' AS metric FROM events""")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs in seconds or milliseconds, times in folder names, changes as text, metric names (SU16, SU17, SU20, SF52)."""
    ts = F.col("ts").cast("timestamp")
    s = F.unix_seconds(ts)
    folder = F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("_"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", misc.epoch_seconds(F.when(F.col("event_id") % 2 == 0, s).otherwise(s * 1000)).alias("seconds"), F.date_format(misc.run_time(folder), "yyyy-MM-dd HH:mm:ss").alias("run_time"), misc.percent_delta(F.lit(7.0), F.floor("value").cast("double")).alias("change"), misc.metric_key(F.concat(F.upper("event_type"), F.lit("@5"))).alias("metric"))


@query("""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT conv_id, turn, right(text, 12) || CASE WHEN turn % 2 = 0 THEN ' to follow' ELSE '' END AS text FROM conversations))
SELECT conv_id, turn, CAST(list_max(list_filter(range(0, least(length(text), length(nxt), 20) + 1), lambda k: right(text, k) = left(nxt, k))) AS INTEGER) AS overlap FROM t WHERE nxt IS NOT NULL""")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each turn's end begins the next (J24, SF13)."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.right("text", F.lit(12)), F.when(F.col("turn") % 2 == 0, " to follow").otherwise(""))
    found = ds.chunk_overlaps(c.select(F.col("conv_id").alias("source"), F.lit(1).alias("page"), F.col("turn").alias("chunk_index"), text.alias("content")), 20)
    return found.select(F.col("source").alias("conv_id"), F.col("chunk_index").alias("turn"), "overlap")


@query(r"""WITH w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, substr(sha256(CASE WHEN prev IS NULL THEN text ELSE array_to_string(list_slice(string_split(prev, ' '), greatest(1, len(string_split(prev, ' ')) - 2), len(string_split(prev, ' '))), ' ') || ' ' || text END), 1, 16) AS hash FROM w""")
def overlap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn after the last three words of the one before (WN7)."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return ch.overlapped(c, 3).select(F.col("doc_id").alias("conv_id"), F.col("chunk_index").alias("turn"), tx.content_hash(F.col("content")).alias("hash"))


CLINICAL = "CASE turn % 4 WHEN 0 THEN 'PLAN:' || chr(10) || text || ' take 5 mg daily' WHEN 1 THEN text || chr(10) || 'dose: 10 ml' WHEN 2 THEN text || chr(10) || '| normal | x |' ELSE 'bid ' || text END"


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with what a clinical text might hold: (conv_id, turn, content)."""
    t, k = F.col("text"), F.col("turn") % 4
    made = F.when(k == 0, F.concat(F.lit("PLAN:\n"), t, F.lit(" take 5 mg daily"))).when(k == 1, F.concat(t, F.lit("\ndose: 10 ml"))).when(k == 2, F.concat(t, F.lit("\n| normal | x |"))).otherwise(F.concat(F.lit("bid "), t))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("content"))


SQL_DOSING = "regexp_matches({x}, '(?i)(?:" + "|".join(md.DOSING) + ")')"
SQL_LAB = "(contains({x}, '|') AND regexp_matches({x}, '(?i)(?:" + "|".join(md.LAB_TABLES) + ")'))"
HAS = "regexp_matches({x}, '" + md.DOSE + "')"
OFTEN = "regexp_matches({x}, '" + md.FREQUENCY + "')"


@query(f"""WITH c AS (SELECT conv_id, turn, {CLINICAL} AS c FROM conversations)
SELECT conv_id, turn, round(greatest(0, least(1, 0.5 + CASE WHEN starts_with(c, 'PLAN:') THEN 0.2 ELSE 0 END
 + CASE WHEN {SQL_DOSING.format(x="c")} AND {HAS.format(x="c")} AND {OFTEN.format(x="c")} THEN 0.15 WHEN {SQL_DOSING.format(x="c")} AND ({HAS.format(x="c")} OR {OFTEN.format(x="c")}) THEN -0.1 ELSE 0 END
 + CASE WHEN {SQL_LAB.format(x="c")} THEN CASE WHEN len(list_filter(string_split(c, chr(10)), lambda l: contains(l, '|'))) >= 2 THEN 0.15 ELSE -0.2 END ELSE 0 END)), 6)::DOUBLE AS score FROM c""")
def preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How whole a chunk's clinical structure is (SF44)."""
    return clinical(spark, sf_dir).select("conv_id", "turn", F.round(md.preservation_score(F.col("content")), 6).alias("score"))


LAST, FIRST = "list_last(string_split(c, chr(10)))", "string_split(nxt, chr(10))[1]"


@query(f"""WITH c AS (SELECT conv_id, turn, {CLINICAL} AS c, lead({CLINICAL}) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT conv_id, turn, ({SQL_DOSING.format(x="c")} AND {SQL_DOSING.format(x="nxt")} AND {SQL_DOSING.format(x=LAST)})
 OR (({SQL_LAB.format(x="c")} OR {SQL_LAB.format(x="nxt")}) AND list_contains(string_split(c, chr(10)), '|') AND contains({FIRST}, '|')) AS whole FROM c WHERE nxt IS NOT NULL""")
def unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places between turns that had better not be a chunk's end (SF43)."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    both = clinical(spark, sf_dir).withColumn("next", F.lead("content").over(w)).where("next IS NOT NULL")
    return both.select("conv_id", "turn", md.avoids_split(F.col("content"), F.col("next")).alias("whole"))


@query(f"""WITH c AS (SELECT conv_id, turn, {CLINICAL} AS c, lead({CLINICAL}) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
f AS (SELECT *, nxt IS NOT NULL AND ({SQL_LAB.format(x="c")} OR {SQL_LAB.format(x="nxt")} OR ({SQL_DOSING.format(x="c")} AND {HAS.format(x="c")} AND NOT {OFTEN.format(x="c")})
  OR (regexp_matches(c || ' ' || nxt, '(?i)[a-z]+tion') AND regexp_matches(c || ' ' || nxt, '(?i)\\d+\\s*(?:mg|mcg|g|ml|units?)'))) AS w FROM c),
r AS (SELECT *, coalesce(sum(CASE WHEN w THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) AS place FROM r)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS chunk_index, w AS merged, substr(sha256(CASE WHEN w THEN c || ' ' || nxt ELSE c END), 1, 16) AS hash FROM p WHERE place % 2 = 1""")
def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that belong together as one chunk, in pairs, numbered anew (TV19, TV20, SF47)."""
    rows = clinical(spark, sf_dir).withColumnRenamed("turn", "chunk_index")
    found = lambda a, b: F.regexp_extract_all(F.concat_ws(" ", a, b), F.lit("(?i)[a-z]+tion"), F.lit(0))
    out = ch.merge_pairs(rows, lambda a, b: md.should_merge(a, b, found(a, b)), key="conv_id")
    return out.select("conv_id", "chunk_index", "merged", tx.content_hash(F.col("content")).alias("hash"))


@query()
def clinical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut at clinical headers, merged in pairs, with their scores (TV18)."""
    d = clinical(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit("note.pdf").alias("source"), F.col("content").alias("text"))
    return ch.chunk_by("medical_semantic", d, drugs=["[a-z]+tion"]).select("doc_id", "id", "chunk_index", "start_char", "end_char", "char_count", F.round("preservation", 6).alias("preservation"))


PLACES = "list_sum(list_transform(range(1, len(m{n}) + 1), lambda i: list_sum(list_transform(g{n}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{n}[1:i - 1], lambda x: length(x))), 0)))"


@query(f"""WITH e AS (SELECT conv_id, turn, regexp_extract_all(text, '(?i)[a-z]{{2,}}tion') AS m1, string_split_regex(text, '(?i)[a-z]{{2,}}tion') AS g1, regexp_extract_all(text, '(?i)th[a-z]{{3,}}') AS m2, string_split_regex(text, '(?i)th[a-z]{{3,}}') AS g2 FROM conversations)
SELECT conv_id, turn, CAST(len(m1) AS BIGINT) AS drugs, CAST(len(m2) AS BIGINT) AS conditions, CAST(coalesce({PLACES.format(n=1)}, 0) + coalesce({PLACES.format(n=2)}, 0) AS BIGINT) AS places, round(len(m1) * 0.7 + len(m2) * 0.8, 6)::DOUBLE AS confidence FROM e""")
def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by patterns, with places and confidences (SF45, UD22)."""
    e = table(spark, sf_dir, "conversations").select("conv_id", "turn", md.entities(F.col("text"), ["[a-z]{2,}tion"], ["th[a-z]{3,}"]).alias("e"))
    of = lambda label: F.size(F.filter("e", lambda x: x["label"] == label)).cast("long")
    return e.select("conv_id", "turn", of("DRUG").alias("drugs"), of("DISEASE").alias("conditions"), F.aggregate("e", F.lit(0).cast("long"), lambda n, x: n + x["start"]).alias("places"), F.round(F.aggregate("e", F.lit(0.0), lambda n, x: n + x["confidence"]), 6).alias("confidence"))


@query(r"""WITH e AS (SELECT conv_id, turn, length(text) AS n, instr(lower(text), 'tion') - 1 AS place FROM conversations)
SELECT conv_id, turn, CAST((place > 0)::INT + (place + 4 < n)::INT AS BIGINT) AS hints, CAST((CASE WHEN place > 0 THEN place ELSE 0 END) + (CASE WHEN place + 4 < n THEN place + 4 ELSE 0 END) AS BIGINT) AS places FROM e WHERE place >= 0""")
def boundary_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places before and after an entity (SF46)."""
    at = F.instr(F.lower("text"), "tion") - 1
    spans = F.array(F.struct(at.alias("start"), (at + 4).alias("end"), F.lit("DRUG").alias("label")))
    h = table(spark, sf_dir, "conversations").where(at >= 0).select("conv_id", "turn", misc.boundary_hints(spans, F.length("text")).alias("h"))
    return h.select("conv_id", "turn", F.size("h").cast("long").alias("hints"), F.aggregate("h", F.lit(0).cast("long"), lambda n, x: n + x["at"]).alias("places"))


ANSWER = "CASE turn % 4 WHEN 0 THEN ' Treatment | ' || text WHEN 1 THEN 'nonsense' WHEN 2 THEN NULL ELSE 'risk_factor|a|b' END"


@query(f"""WITH a AS (SELECT conv_id, turn, {ANSWER} AS a FROM conversations), p AS (SELECT *, lower(trim(string_split(a, '|')[1])) AS t, instr(a, '|') AS bar FROM a)
SELECT conv_id, turn, CASE WHEN t IN ('definition', 'comparison', 'reference_range', 'symptom_query', 'treatment', 'risk_factor', 'follow_up', 'complex') THEN t ELSE 'definition' END AS query_type, CASE WHEN a IS NULL THEN 0.3 ELSE 0.6 END::DOUBLE AS confidence,
CASE WHEN a IS NULL THEN 'LLM classification failed, defaulting to definition' WHEN bar > 0 THEN 'LLM: ' || trim(substr(a, bar + 1)) ELSE 'LLM: LLM classification' END AS reasoning FROM p""")
def classified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's answer says of a question's class (UD19)."""
    k = F.col("turn") % 4
    answer = F.when(k == 0, F.concat(F.lit(" Treatment | "), F.col("text"))).when(k == 1, "nonsense").when(k == 3, "risk_factor|a|b")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", qs.classify_answer(answer).alias("c")).select("conv_id", "turn", "c.*")


@query(r"""WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'What is ' ELSE 'define explain ' END || text AS q, text FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(q), '^(?i:what is )', ''), '^(?i:define )', ''), '^(?i:explain )', ''), '^(?i:meaning of )', '')) AS bare,
left(text, 100) AS query, length(text) > 100 AS cut, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 50), ' ') AS words, CASE WHEN turn % 2 = 0 THEN 0.2 ELSE 0.0 END::DOUBLE AS boost FROM q""")
def question_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without their lead, cut, in few words, with a table's boost (SF35, SF36, SF54, SF55, SF57)."""
    t = F.col("text")
    q = F.concat(F.when(F.col("turn") % 3 == 0, "What is ").otherwise("define explain "), t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", qs.strip_definition(q).alias("bare"), misc.cut_query(t, 100).alias("c"), misc.first_words(t, F.lit(10)).alias("words"), misc.table_boost(F.lit("table"), F.when(F.col("turn") % 2 == 0, "reference_range").otherwise("other")).alias("boost")).select("conv_id", "turn", "bare", "c.query", "c.cut", "words", "boost")


@query(r"""WITH a AS (SELECT conv_id, turn, unnest(list_slice(list_filter(list_transform(string_split('1. ' || replace(text, '. ', chr(10) || '- '), chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:\d+[.)]|[-*•])\s*', ''))), lambda x: length(x) > 10), 1, 2)) AS question FROM conversations)
SELECT conv_id, turn, question FROM a""")
def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two questions of an answer's lines (SF56, TK14)."""
    answer = F.concat(F.lit("1. "), F.replace("text", F.lit(". "), F.lit("\n- ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(enrich.parse_questions(answer)).alias("question"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', chr(10), 'gis'), '<style\b.*?</style>', chr(10), 'gis'), '<nav\b.*?</nav>', chr(10), 'gis'), '<footer\b.*?</footer>', chr(10), 'gis'), '<header\b.*?</header>', chr(10), 'gis') AS h FROM pages)
SELECT page_id, substr(sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(h, '<[^>]*>', chr(10), 'gs'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 2), chr(10))), 1, 16) AS hash FROM b""")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible lines of pages without furniture (SF51)."""
    return table(spark, sf_dir, "pages").select("page_id", tx.content_hash(misc.clean_html_text(F.col("html"))).alias("hash"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"kind":"text","source":"' || source || '"}') AS identity, sha256(encode(text)) AS content FROM documents""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of named values and of bytes (SU11, SU12, SU14, SU15, SU18)."""
    value = F.struct("doc_id", F.lit("text").alias("kind"), "source")
    return docs(spark, sf_dir).select("doc_id", misc.identity_hash(value).alias("identity"), misc.file_hash(F.col("text").cast("binary")).alias("content"))


@query("""SELECT doc_id, CAST(1 + (lang IS NOT NULL)::INT + (doc_id % 2 = 0)::INT AS INTEGER) AS kept FROM documents""")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named keys of a document's metadata that have values (PF16)."""
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("even"), F.when(F.col("doc_id") % 2 == 0, "yes"), F.lit("other"), F.lit("x"))
    return docs(spark, sf_dir).select("doc_id", F.size(ds.page_metadata(m, ("source", "lang", "even"))).alias("kept"))


@query(r"""WITH w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]{4,}')) AS word FROM documents) GROUP BY ALL),
k AS (SELECT doc_id, string_agg(word, ',' ORDER BY n DESC, word) AS keywords FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) <= 5) GROUP BY doc_id)
SELECT d.doc_id, coalesce(keywords, '') AS keywords, CAST(length(nullif(trim(substr(string_split(text, '. ')[1], 1, 200)), '')) AS INTEGER) AS summary_chars FROM documents d LEFT JOIN k USING (doc_id)""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and summaries of every document by the offline client (UD5, SF20, SF21, J5, TK14)."""
    asked = enrich.ask(docs(spark, sf_dir).select("doc_id", "text"), "text", enrich.stub_client)
    return asked.select("doc_id", enrich.parse_enrichment(F.col("answer")).alias("e")).select("doc_id", F.array_join("e.keywords", ",").alias("keywords"), F.length("e.summary").alias("summary_chars"))


@query(r"""WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ctx FROM conversations),
w AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]{4,}')) AS a, list_distinct(regexp_extract_all(lower(coalesce(ctx, '')), '[\p{L}\p{Nl}\p{No}]{4,}')) AS c FROM a),
s AS (SELECT query_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, c))::DOUBLE / len(a) END AS score FROM w)
SELECT query_id, 'grounded' AS metric, round(score, 6) AS score, score >= 0.1 AS passed, NULL AS reason FROM s UNION ALL SELECT query_id, 'unreachable', NULL, false, 'ConnectionError' FROM s
UNION ALL SELECT conv_id * 1000 + turn, 'slow', CASE WHEN length(coalesce(text, '')) % 499 <> 0 THEN 1.0 END, length(coalesce(text, '')) % 499 <> 0, CASE WHEN length(coalesce(text, '')) % 499 = 0 THEN 'timeout' END FROM conversations""")
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by judges with thresholds and deadlines; a judge that fails or is late leaves no score
    but a reason (UD13, UD14)."""
    import time

    from pyspark.sql import Window

    def unreachable(question: str, context: str, answer: str) -> float:
        raise ConnectionError("no such judge")

    def slow(question: str, context: str, answer: str) -> float:
        if len(answer) % 499 == 0:
            time.sleep(30)
        return 1.0

    w = Window.partitionBy("conv_id").orderBy("turn")
    a = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lit("").alias("question"), F.lag("text").over(w).alias("context"), F.col("text").alias("answer"))
    judges = {"grounded": enrich.overlap_judge, "unreachable": unreachable, "slow": slow}
    return enrich.judged(a, judges, {"grounded": 0.1, "unreachable": 0.5, "slow": 0.5}, timeout_s=3.0, at_once=16).withColumn("score", F.round("score", 6))
