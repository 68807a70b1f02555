"""A query for each operator over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORY, CATEGORY_KEYWORDS, CLASS_KEYWORDS, CLASS_SUFFIXES, COUNTRY_NAMES, FIELDS, NOISE_WORDS, PRODUCER_VERBS, REFERENCE_FIELDS, STATE_CODES, STATE_NAMES, STATES, WARNING
from ..functions import extract as X
from ..functions import text as T
from ..functions.similarity import partial_ratio
from ..operators import compare as C
from ..operators import documents as D
from ..operators import layout as L
from ..operators import match as M
from ..operators import redecide as R
from ..operators import store as S
from ..operators import verdict as V
from ..operators.heading import heading_bold, word_density
from ..sources.files import docx_file, images_of, read_folders, texts_of, write_files
from ..storage import drop_table, kept_table, scratch_path
from ..streaming.arrivals import run_arrivals
from .inputs import dealt_parts, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- pieces of DuckDB SQL -----------------------------------------------------------

PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def norm(x: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({x}, '')), '{PUNCT}', ''), '\\s+', ' ', 'g'))"


def got(x: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_matches({x}, '^\\s*$'))"


VOL = r"(?i)(\d+(?:\.\d+)?)\s*(m\.?l\.?|liters?|litres?|l|fl\.?\s?oz\.?)"


def ml(x: str) -> str:
    unit = f"lower(regexp_replace({got(x, VOL, 2)}, '[.\\s]', '', 'g'))"
    return f"(CAST({got(x, VOL, 1)} AS DOUBLE) * CASE WHEN {unit} LIKE 'floz%' THEN CAST(29.5735 AS DOUBLE) WHEN {unit} LIKE 'l%' THEN CAST(1000 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)"


PCT, PRF = r"(\d{1,3}(?:\.\d+)?)\s*%", r"(?i)(\d{2,3}(?:\.\d+)?)\s*PROOF"


def pct(x: str) -> str:
    return f"coalesce(CAST({got(x, PCT, 1)} AS DOUBLE), CAST({got(x, PRF, 1)} AS DOUBLE) / CAST(2 AS DOUBLE))"


def prf(x: str) -> str:
    return f"coalesce(CAST({got(x, PRF, 1)} AS DOUBLE), CAST({got(x, PCT, 1)} AS DOUBLE) * CAST(2 AS DOUBLE))"


def tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')), ' ')"


def ratio(a: str, b: str) -> str:
    """Indel ratio by rows of the subsequence table; each row is a running maximum."""
    row = f"list_transform(range(1, length({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN ord(substr({b}, k, 1)) = letter[1] THEN greatest(above[k], coalesce(above[k - 1], 0) + 1) ELSE above[k] END)))"
    rows = f"list_concat([list_transform(range(1, length({b}) + 1), lambda i: 0)], list_transform(string_split({a}, ''), lambda c: [ord(c)]))"
    lcs = f"list_last(list_reduce({rows}, lambda above, letter: {row}))"
    return f"CASE WHEN {a} = {b} THEN CAST(100 AS DOUBLE) WHEN length({a}) = 0 OR length({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(200 AS DOUBLE) * {lcs} / (length({a}) + length({b})) END"


ZIP, CODE = r"\b\d{5}(?:-\d{4})?\b", rf"\b(?:{STATE_CODES})\b"
NAME, LAND = rf"(?i:\b(?:{STATE_NAMES})\b)", rf"(?i:\b(?:{COUNTRY_NAMES})\b)"
VERB = "|".join(PRODUCER_VERBS)
BY = rf"\b(?:{VERB})(?:\s+AND\s+(?:{VERB}))*\s+BY\b\s*[:\-]?\s*"


def state(x: str) -> str:
    raw = f"regexp_replace(upper(coalesce({got(x, CODE)}, {got(x, NAME)})), '\\s+', ' ', 'g')"
    pairs = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in STATES.items())
    return f"(CASE {raw} {pairs} ELSE {raw} END)"


def abbreviated(x: str) -> str:
    for name in sorted(STATES, key=lambda n: -len(n)):
        x = f"regexp_replace({x}, '(?i)\\b{name.replace(' ', chr(92) + 's+')}\\b', '{STATES[name]}', 'g')"
    return x


def keywords(x: str) -> str:
    noise = ", ".join(f"'{w}'" for w in NOISE_WORDS)
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda w: NOT list_contains([{noise}], w) AND NOT regexp_matches(w, '^\\d+$') AND length(w) > 1))"


def category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({norm(x)}, '\\b{k}\\b') THEN '{CATEGORY[k]}'" for k in CATEGORY_KEYWORDS) + " END"


def fuzzy_status(x: str, e: str, ok: str) -> str:
    return f"CASE WHEN {blank(x)} THEN CASE WHEN {blank(e)} THEN 'match' ELSE 'not_found' END WHEN {blank(e)} THEN 'match' WHEN {ok} THEN 'match' ELSE 'mismatch' END"


def fuzzy_score(x: str, e: str, score: str) -> str:
    return f"CASE WHEN {blank(x)} OR {blank(e)} THEN NULL ELSE {score} END"


# ---- scalar functions --------------------------------------------------------------------


@query(f"SELECT doc_id, md5({norm('text')}) AS normalized_md5, {blank('text')} AS blank FROM documents")
def q01_normalize_text(spark, d):
    text = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(T.normalize_text(text).cast("binary")).alias("normalized_md5"), T.is_blank(text).alias("blank"))


@query(with_views(f"SELECT id, net_contents, {ml('net_contents')} AS ml FROM library UNION ALL SELECT photo_id AS id, net_contents, {ml('net_contents')} AS ml FROM readings", "library", "readings"))
def q02_volume_ml(spark, d):
    both = view(spark, d, "library").select("id", "net_contents").unionByName(view(spark, d, "readings").select(F.col("photo_id").alias("id"), "net_contents"))
    return both.withColumn("ml", T.volume_ml(F.col("net_contents")))


@query(with_views(f"SELECT photo_id, {pct('alcohol_content')} AS percent, {prf('alcohol_content')} AS proof FROM readings", "readings"))
def q03_abv_pct_proof(spark, d):
    x = F.col("alcohol_content")
    return view(spark, d, "readings").select("photo_id", T.abv_percent(x).alias("percent"), T.abv_proof(x).alias("proof"))


AFTER = r"(?i)(\d{1,3}(?:\.\d+)?)\s*%\s*ALC(?:OHOL)?\.?\s*(?:BY|/)\s*VOL\.?"
BEFORE = r"(?i)ALC(?:OHOL)?\.?(?:\s*(?:BY\s*)?/?\s*VOL(?:UME)?\.?)?\s*[:\-]?\s*(\d{1,3}(?:\.\d+)?)\s*%"


@query(with_views(f"SELECT label_id, coalesce(p || '% ALC/VOL (' || q || ' PROOF)', p || '% ALC/VOL', q || ' PROOF') AS alcohol_content FROM (SELECT label_id, coalesce({got('raw_text', AFTER, 1)}, {got('raw_text', BEFORE, 1)}) AS p, {got('raw_text', PRF, 1)} AS q FROM label_text)", "label_text"))
def q04_extract_abv(spark, d):
    return view(spark, d, "label_text").select("label_id", X.extract_abv(F.col("raw_text")).alias("alcohol_content"))


NETC = r"(?i)\b(\d+(?:\.\d+)?)\s*(m\.?l\.?|liters?|litres?|l|fl\.?\s?oz\.?)\b"


@query(with_views(f"SELECT label_id, {got('raw_text', NETC, 1)} || ' ' || {got('raw_text', NETC, 2)} AS net_contents FROM label_text", "label_text"))
def q05_extract_net_contents(spark, d):
    return view(spark, d, "label_text").select("label_id", X.extract_net_contents(F.col("raw_text")).alias("net_contents"))


CTRY = r"(?i)PRODUCT\s+OF\s+([A-Za-z][A-Za-z\s]{1,40})"


@query(with_views(f"SELECT label_id, nullif(trim(string_split_regex(trim({got('raw_text', CTRY, 1)}, ' ' || chr(10)), '\\s{{2,}}|[\\r\\n]')[1], ' .,'), '') AS country FROM label_text", "label_text"))
def q06_extract_country(spark, d):
    return view(spark, d, "label_text").select("label_id", X.extract_country(F.col("raw_text")).alias("country"))


@query(with_views(r"SELECT label_id, trim(regexp_replace(nullif(regexp_extract(raw_text, '(?is)GOVERNMENT\s+WARNING.{0,600}'), ''), '\s+', ' ', 'g')) AS warning, nullif(regexp_extract(raw_text, '(?i)GOVERNMENT\s+WARNING'), '') = upper(nullif(regexp_extract(raw_text, '(?i)GOVERNMENT\s+WARNING'), '')) AS caps FROM label_text", "label_text"))
def q07_extract_warning_caps(spark, d):
    x = F.col("raw_text")
    return view(spark, d, "label_text").select("label_id", X.extract_warning(x).alias("warning"), X.heading_all_caps(x).alias("caps"))


def _class_sql(x: str) -> str:
    ends = "|".join(CLASS_SUFFIXES)
    cases = []
    for k in CLASS_KEYWORDS:
        words = k.replace(" ", r"\s{1,20}")
        snippet = f"regexp_extract({x}, '(?i)({words})(?:(\\s+(?:{ends}))(?:[^A-Za-z]|$))?', 1) || coalesce(regexp_extract({x}, '(?i)({words})(?:(\\s+(?:{ends}))(?:[^A-Za-z]|$))?', 2), '')"
        cases.append(f"WHEN regexp_matches({x}, '(?i){words}') THEN {snippet}")
    raw = f"trim(regexp_replace(CASE {' '.join(cases)} END, '\\s+', ' ', 'g'))"
    raw = f"trim(regexp_replace({raw}, '(?i)^\\s*(?:CLASS\\s*(?:AND|/)?\\s*TYPE(?:\\s*OF\\s*PRODUCT)?|TYPE\\s*OF\\s*PRODUCT|CLASS)\\s*[:\\-]?\\s*', ''))"
    return f"trim(regexp_replace({raw}, '(?i)\\s*[(\\[]?\\s*(?:FRONT|BACK|SIDE|NECK|MAIN)(?:\\s+LABEL)?\\s*[)\\]]?\\s*$', ''))"


@query(with_views(f"SELECT label_id, {_class_sql('raw_text')} AS class_type FROM label_text", "label_text"))
def q08_extract_class_type(spark, d):
    return view(spark, d, "label_text").select("label_id", X.extract_class_type(F.col("raw_text")).alias("class_type"))


BOX = r"[\[(]?\b[Xx☒☑][\])]?\s*[:\-]?\s*((?i:WINE|DISTILLED\s+SPIRITS|MALT\s+BEVERAGE))\b"


@query(with_views(f"SELECT label_id, CASE lower(regexp_replace({got('raw_text', BOX, 1)}, '\\s+', ' ', 'g')) WHEN 'wine' THEN 'Wine' WHEN 'distilled spirits' THEN 'Distilled Spirits' WHEN 'malt beverage' THEN 'Malt Beverage' END AS class_type FROM label_text", "label_text"))
def q09_checkbox_class(spark, d):
    return view(spark, d, "label_text").select("label_id", X.extract_checkbox_class(F.col("raw_text")).alias("class_type"))


@query(with_views(f"SELECT id, {state('producer_info')} AS state, {abbreviated('producer_info')} AS abbreviated FROM library", "library"))
def q10_state_normalize(spark, d):
    x = F.col("producer_info")
    return view(spark, d, "library").select("id", T.state_of(x).alias("state"), T.normalize_states(x).alias("abbreviated"))


NOISY = "'Bottled by ' || producer_info || ' (Front Label) see back'"
STRIPPED = f"trim(regexp_replace(x, '(?is)^(.*?){BY}', '\\1'), ' ,.-')"


@query(with_views(f"SELECT id, coalesce(trim(nullif(regexp_extract({STRIPPED}, '(?s)^(.*(?:{ZIP}|{CODE}|{NAME}|{LAND}))', 1), ''), ' ,.-'), {STRIPPED}) AS producer, regexp_matches(x, '{ZIP}|{CODE}|{NAME}|{LAND}') AS ends FROM (SELECT id, {NOISY} AS x FROM library)", "library"))
def q11_address_trim(spark, d):
    x = F.concat(F.lit("Bottled by "), "producer_info", F.lit(" (Front Label) see back"))
    return view(spark, d, "library").select("id", T.finalize_producer(x).alias("producer"), T.looks_like_address_end(x).alias("ends"))


# ---- layout ------------------------------------------------------------------------------------

LINES = """words AS (SELECT photo_id, word_seq, trim(text) AS text, "left", top, height, block_num, par_num, line_num FROM ocr_words
  WHERE trim(text) <> '' AND coalesce(TRY_CAST(conf AS DOUBLE), -1) >= 30),
lines AS (SELECT photo_id, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY "left", word_seq) AS text, avg(height) AS height,
  min(top) AS top, min("left") AS "left", min(word_seq) AS first_seq FROM words GROUP BY ALL)"""


def _lines(spark, d):
    return L.group_lines(L.confident_words(view(spark, d, "ocr_words")))


@query(with_views("", "ocr_words") + ", " + LINES + ' SELECT photo_id, line_num, text, height, top, "left", first_seq FROM lines')
def q13_group_lines(spark, d):
    return _lines(spark, d).select("photo_id", "line_num", "text", "height", "top", "left", F.col("first_seq").cast("long").alias("first_seq"))


def _walk(name: str, lines: str, start: str, most: int, gap: float, down: bool) -> str:
    away = "pos - origin" if down else "origin - pos"
    space = "top - (ptop + ph)" if down else "ptop - (top + height)"
    return f"""{name}_p AS (SELECT l.*, row_number() OVER (PARTITION BY l.photo_id ORDER BY top, "left", first_seq) AS pos, s.start_seq FROM {lines} l JOIN {start} s USING (photo_id)),
{name}_o AS (SELECT photo_id, pos AS origin FROM {name}_p WHERE first_seq = start_seq),
{name}_n AS (SELECT p.*, {away} AS step FROM {name}_p p JOIN {name}_o USING (photo_id) WHERE {away} >= 0 AND {away} < {most}),
{name}_g AS (SELECT *, lag(height) OVER w AS ph, lag(top) OVER w AS ptop FROM {name}_n WINDOW w AS (PARTITION BY photo_id ORDER BY step)),
{name} AS (SELECT * FROM (SELECT *, min(CASE WHEN step = 0 OR (height >= ph * CAST(0.6 AS DOUBLE) AND height <= ph / CAST(0.6 AS DOUBLE) AND {space} <= ph * CAST({gap} AS DOUBLE)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY photo_id ORDER BY step) AS ok FROM {name}_g) WHERE ok = 1)"""


FIRST = 'start AS (SELECT photo_id, min_by(first_seq, (top, "left", first_seq)) AS start_seq FROM lines GROUP BY photo_id)'


@query(with_views("", "ocr_words") + ", " + LINES + ", " + FIRST + ", " + _walk("c", "lines", "start", 6, 1.8, True) + " SELECT photo_id, step, text FROM c")
def q14_cluster_lines(spark, d):
    lines = _lines(spark, d)
    start = lines.groupBy("photo_id").agg(F.min(F.struct("top", "left", "first_seq")).alias("at")).select("photo_id", F.col("at.first_seq").alias("first_seq"))
    return L.cluster(lines, start, 6, 1.8).select("photo_id", F.col("step").cast("long").alias("step"), "text")


NOT_BRAND = "GOVERNMENT WARNING|PRODUCED|BOTTLED|IMPORTED|DISTILLED|VINTED|BREWED|PRODUCT OF|PROOF|ALC|VOL|%"
TALLEST = 'tall AS (SELECT photo_id, min_by(first_seq, (-height, top, first_seq)) AS start_seq FROM free GROUP BY photo_id)'


@query(with_views("", "ocr_words") + ", " + LINES + f", free AS (SELECT * FROM lines WHERE NOT regexp_matches(text, '(?i){NOT_BRAND}')), " + TALLEST + ", " + _walk("dn", "free", "tall", 4, 2.5, True) + ", " + _walk("up", "free", "tall", 4, 2.5, False)
       + " SELECT photo_id, string_agg(text, ' ' ORDER BY o) AS brand_name FROM (SELECT photo_id, text, step AS o FROM dn UNION ALL SELECT photo_id, text, -step AS o FROM up WHERE step > 0) GROUP BY photo_id")
def q15_brand_from_layout(spark, d):
    return L.brand_names(_lines(spark, d))


@query()
def q16_producer_from_layout(spark, d):
    return L.producers(_lines(spark, d))


# ---- comparisons ---------------------------------------------------------------------------------


def _pairs(spark, d, field):
    x = view(spark, d, "readings").select(F.col(field).alias("x")).distinct()
    return x.join(view(spark, d, "library").select(F.col(field).alias("e")).distinct())


def pairs_sql(field: str, select: str) -> str:
    return with_views(f", pairs AS (SELECT * FROM (SELECT DISTINCT {field} AS x FROM readings), (SELECT DISTINCT {field} AS e FROM library)), sorted AS (SELECT *, {tokens(norm('x'))} AS a, {tokens(norm('e'))} AS b FROM pairs), scored AS (SELECT *, {ratio('a', 'b')} AS ratio FROM sorted) SELECT {select} FROM scored", "library", "readings").replace("supplier) ,", "supplier),").replace(") , pairs", "), pairs")


@query(pairs_sql("brand_name", "x, e, round(ratio, 6) AS ratio"))
def q19_token_sort_ratio(spark, d):
    return _pairs(spark, d, "brand_name").withColumn("ratio", F.round(C.text_ratio(F.col("x"), F.col("e")), 6))


@query()
def q20_partial_ratio(spark, d):
    x, e = X.extract_warning(F.col("raw_text")), F.lit(WARNING)
    return view(spark, d, "label_text").select("label_id", partial_ratio(T.normalize_text(x), T.normalize_text(e)).alias("ratio"))


WINDOWS = f"""pairs AS (SELECT x, e, CASE WHEN length(x) <= length(e) THEN x ELSE e END AS a, CASE WHEN length(x) <= length(e) THEN e ELSE x END AS b
  FROM (SELECT DISTINCT {norm('brand_name')} AS x FROM readings) CROSS JOIN (SELECT DISTINCT {norm('class_type')} AS e FROM library)),
turned AS (SELECT x, e, a, b FROM pairs UNION ALL SELECT x, e, b, a FROM pairs WHERE length(a) = length(b)),
cut AS (SELECT x, e, a, substr(b, greatest(s, 0) + 1, s + length(a) - greatest(s, 0)) AS part FROM (SELECT *, unnest(range(1 - length(a), length(b))) AS s FROM turned WHERE length(a) > 0)),
tried AS (SELECT DISTINCT a, part FROM cut), scores AS (SELECT a, part, {ratio('a', 'part')} AS score FROM tried)"""


@query(with_views(", " + WINDOWS + " SELECT p.x, p.e, CASE WHEN length(p.a) = 0 THEN CASE WHEN length(p.b) = 0 THEN 100 ELSE 0 END ELSE round(max(score), 6) END AS ratio FROM pairs p LEFT JOIN cut USING (x, e) LEFT JOIN scores s ON s.a = cut.a AND s.part = cut.part GROUP BY p.x, p.e, p.a, p.b", "library", "readings").replace(") , pairs", "), pairs").replace("supplier ,", "supplier,"))
def q51_partial_ratio_pairs(spark, d):
    """The best stretch of every brand that was read with every designation of the library."""
    x = view(spark, d, "readings").select(T.normalize_text(F.col("brand_name")).alias("x")).distinct()
    e = view(spark, d, "library").select(T.normalize_text(F.col("class_type")).alias("e")).distinct()
    return x.join(e).withColumn("ratio", F.round(partial_ratio(F.col("x"), F.col("e")), 6))


def _compared(spark, d, field, broad=False):
    return C.scored_pairs(_pairs(spark, d, field), field, broad_class=broad).select("x", "e", F.col("c.status").alias("status"), F.round("c.score", 6).alias("score"))


def text_sql(field: str, rescue: str = "false") -> str:
    return pairs_sql(field, f"x, e, {fuzzy_status('x', 'e', f'(ratio >= 85 OR coalesce({rescue}, false))')} AS status, round({fuzzy_score('x', 'e', 'ratio')}, 6) AS score")


@query(text_sql("brand_name"))
def q21_compare_text(spark, d):
    return _compared(spark, d, "brand_name")


def measure_sql(field: str, gap: str, ok: str, score: str) -> str:
    status = f"CASE WHEN {blank('x')} THEN 'not_found' WHEN {blank('e')} THEN 'match' WHEN {gap} IS NOT NULL THEN CASE WHEN {ok} THEN 'match' ELSE 'mismatch' END WHEN ratio >= 85 THEN 'match' ELSE 'mismatch' END"
    return pairs_sql(field, f"x, e, {status} AS status, round({fuzzy_score('x', 'e', f'CASE WHEN {gap} IS NOT NULL THEN {score} ELSE ratio END')}, 6) AS score")


ABV_GAP = f"abs({pct('x')} - {pct('e')})"
VOL_GAP = f"(abs({ml('x')} - {ml('e')}) / {ml('e')} * CAST(100 AS DOUBLE))"


@query(measure_sql("alcohol_content", ABV_GAP, f"{ABV_GAP} <= CAST(0.3 AS DOUBLE)", f"greatest(CAST(0 AS DOUBLE), CAST(100 AS DOUBLE) - {ABV_GAP} * CAST(10 AS DOUBLE))"))
def q22_compare_abv(spark, d):
    return _compared(spark, d, "alcohol_content")


@query(measure_sql("net_contents", VOL_GAP, f"{VOL_GAP} <= CAST(1 AS DOUBLE)", f"greatest(CAST(0 AS DOUBLE), CAST(100 AS DOUBLE) - {VOL_GAP})"))
def q23_compare_volume(spark, d):
    return _compared(spark, d, "net_contents")


@query(with_views(f"SELECT DISTINCT class_type, {category('class_type')} AS category FROM library", "library"))
def q24_broad_category(spark, d):
    return view(spark, d, "library").select("class_type").distinct().withColumn("category", T.broad_category(F.col("class_type")))


BROAD = f"({state('x')} = {state('e')} AND least(len({keywords(abbreviated('x'))}), len({keywords(abbreviated('e'))})) >= 2 AND len(list_intersect({keywords(abbreviated('x'))}, {keywords(abbreviated('e'))})) >= least(3, len({keywords(abbreviated('x'))}), len({keywords(abbreviated('e'))})))"


@query(text_sql("producer_info", BROAD))
def q25_producer_broad_match(spark, d):
    return _compared(spark, d, "producer_info")


@query(text_sql("class_type", f"{category('x')} = {category('e')}"))
def q26_compare_class_broad(spark, d):
    return _compared(spark, d, "class_type", broad=True)


# ---- matching and verdicts ---------------------------------------------------------------------


def _field_cte(field: str) -> str:
    pairs = f"{field}_p AS (SELECT * FROM (SELECT DISTINCT {field} AS x FROM readings), (SELECT DISTINCT {field} AS e FROM library)), {field}_s AS (SELECT *, {tokens(norm('x'))} AS a, {tokens(norm('e'))} AS b FROM {field}_p), {field}_r AS (SELECT *, {ratio('a', 'b')} AS ratio FROM {field}_s)"
    if field in ("alcohol_content", "net_contents"):
        gap, most, per = (ABV_GAP, 0.3, 10) if field == "alcohol_content" else (VOL_GAP, 1, 1)
        status = f"CASE WHEN {blank('x')} THEN 'not_found' WHEN {blank('e')} THEN 'match' WHEN {gap} IS NOT NULL THEN CASE WHEN {gap} <= CAST({most} AS DOUBLE) THEN 'match' ELSE 'mismatch' END WHEN ratio >= 85 THEN 'match' ELSE 'mismatch' END"
        score = fuzzy_score("x", "e", f"CASE WHEN {gap} IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), CAST(100 AS DOUBLE) - {gap} * CAST({per} AS DOUBLE)) ELSE ratio END")
    else:
        rescue = BROAD if field == "producer_info" else "false"
        status, score = fuzzy_status("x", "e", f"(ratio >= 85 OR coalesce({rescue}, false))"), fuzzy_score("x", "e", "ratio")
    return f"{pairs}, {field}_c AS (SELECT x, e, {status} AS status, coalesce({score}, CAST(0 AS DOUBLE)) AS score FROM {field}_r)"


def best_sql(select: str) -> str:
    joins = " ".join(f"JOIN {f}_c ON {f}_c.x IS NOT DISTINCT FROM r.{f} AND {f}_c.e IS NOT DISTINCT FROM l.{f}" for f in REFERENCE_FIELDS)
    matched = " + ".join(f"(CASE WHEN {f}_c.status = 'match' THEN 1 ELSE 0 END)" for f in REFERENCE_FIELDS)
    score = " + ".join(f"{f}_c.score" for f in REFERENCE_FIELDS)
    order = "matched DESC, score DESC, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id"
    ctes = ", ".join(map(_field_cte, REFERENCE_FIELDS))
    return with_views("", "library", "readings") + f", {ctes}, ranked AS (SELECT photo_id, id, matched, score, row_number() OVER (PARTITION BY photo_id ORDER BY {order}) AS n FROM (SELECT r.photo_id, l.id, l.name, {matched} AS matched, {score} AS score FROM readings r CROSS JOIN library l {joins})), best AS (SELECT photo_id, CASE WHEN matched > 0 THEN id END AS product_id, CAST(matched AS INT) AS matched_count, CASE WHEN matched > 0 THEN score ELSE 0 END AS score_sum FROM ranked WHERE n = 1) SELECT {select} FROM best"


@query(best_sql("photo_id, product_id, matched_count, round(score_sum, 6) AS score_sum"))
def q27_best_match(spark, d):
    return M.best_matches(view(spark, d, "readings"), view(spark, d, "library")).withColumn("score_sum", F.round("score_sum", 6))


@query(best_sql("photo_id, product_id, CASE WHEN product_id IS NULL THEN 'none' WHEN matched_count = 6 THEN 'exact' ELSE 'partial' END AS kind"))
def q28_match_kind(spark, d):
    best = M.best_matches(view(spark, d, "readings"), view(spark, d, "library"))
    return best.select("photo_id", "product_id", M.match_kind(F.lit("auto"), F.col("product_id"), F.col("matched_count")).alias("kind"))


def _summary(spark, d):
    return V.aggregate_field(view(spark, d, "photo_results"), "net_contents", ["run_id"], readings=False)


SUMMARY = f""", g AS (SELECT run_id, min(index) FILTER (WHERE status = 'match') AS hit_index, min_by(extracted, index) FILTER (WHERE status = 'match') AS hit,
  list({{'i': index, 'v': extracted}} ORDER BY index) FILTER (WHERE NOT {blank('extracted')}) AS r, min_by(expected, index) AS expected FROM photo_results GROUP BY run_id),
h AS (SELECT *, coalesce(len(r), 0) AS k, coalesce(list_bool_and(list_transform(r[2:], lambda q: abs({ml("r[1].v")} - {ml("q.v")}) / {ml("q.v")} * CAST(100 AS DOUBLE) <= 1)), true) AS agree FROM g),
summary AS (SELECT run_id, CASE WHEN hit_index IS NOT NULL THEN 'match' WHEN k = 0 THEN 'not_found' WHEN agree THEN 'mismatch' ELSE 'disagreement' END AS status,
  CASE WHEN hit_index IS NOT NULL THEN hit WHEN agree THEN r[1].v END AS value, CASE WHEN hit_index IS NOT NULL THEN hit_index WHEN agree THEN r[1].i END AS source_index,
  CAST(CASE WHEN hit_index IS NULL AND k > 0 AND NOT agree THEN k ELSE 0 END AS INT) AS n_values, expected FROM h)"""


@query(with_views("", "photo_results") + SUMMARY + " SELECT * FROM summary")
def q29_group_summary(spark, d):
    return _summary(spark, d)


@query(with_views("", "photo_results") + SUMMARY + " SELECT run_id % 97 AS batch, CASE WHEN bool_and(status = 'match') THEN 'pass' ELSE 'needs_review' END AS overall, count(*) AS fields, count(*) FILTER (WHERE status = 'match') AS matched FROM summary GROUP BY 1")
def q30_overall_status(spark, d):
    by = _summary(spark, d).groupBy((F.col("run_id") % 97).alias("batch"))
    return by.agg(V.overall_status(F.col("status")).alias("overall"), F.count("*").alias("fields"), F.count_if(F.col("status") == "match").alias("matched"))


@query(with_views("", "photo_results") + SUMMARY + ", o AS (SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 3 > 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'match' WHEN o_orderstatus = 'O' THEN 'mismatch' ELSE 'bad' END AS override FROM orders) SELECT s.run_id, coalesce(o.override, s.status) AS status, s.value, CASE WHEN o.override IS NOT NULL THEN s.status END AS computed_status, o.override IS NOT NULL AS manual_override FROM summary s LEFT JOIN (SELECT * FROM o WHERE override <> 'bad') o USING (run_id)")
def q31_manual_override(spark, d):
    """A row of every order; two thirds set no override, some set one that isn't a status."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    over = orders.select(F.col("o_orderkey").alias("run_id"), F.expr("CASE WHEN o_custkey % 3 > 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'match' WHEN o_orderstatus = 'O' THEN 'mismatch' ELSE 'bad' END").alias("override"))
    return V.apply_overrides(_summary(spark, d), over, ["run_id"]).select("run_id", "status", "value", "computed_status", "manual_override")


FOLD = "translate(trim({}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
KEY = "CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Brand ' || CAST(user_id AS STRING) ELSE 'BRAND ' || CAST(user_id AS STRING) END"


@query(f"WITH e AS (SELECT event_id, {FOLD.format(KEY)} AS k FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM e) SELECT event_id FROM f WHERE k = '' OR (n = 1 AND k NOT IN (SELECT {FOLD.format('c_name')} FROM customer))")
def q32_dedup_batch(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(KEY).alias("brand"))
    saved = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("key"))
    return M.first_of_each(events, F.col("brand"), ["event_id"], saved).select("event_id")


# ---- documents, store, files -----------------------------------------------------------------

FORM = """'BRAND NAME' || chr(10) || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE replace(p_brand, 'Brand#', 'Mfr ') END || ' (Front Label)' || chr(10) || '5. CLASS AND TYPE: ' || p_type || chr(10) || 'Net Contents (in metric) - 750 mL'
 || chr(10) || '8. NAME AND ADDRESS OF APPLICANT AS SHOWN ON PERMIT' || chr(10) || p_name || ' Co' || chr(10) || '(if any)' || chr(10) || 'Napa, CA 94558' || chr(10) || 'Rev. 2024'"""


def _forms(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(FORM).alias("text"))


# A value with the word BRAND in it is read as the next heading, so the brand stays null.
@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN replace(p_brand, 'Brand#', 'Mfr ') END AS brand_name, p_type AS class_type, '750 mL' AS net_contents, p_name || ' Co Napa, CA 94558' AS producer_info FROM part")
def q18_document_fields(spark, d):
    return D.document_fields(_forms(spark, d), ["p_partkey"]).select("p_partkey", "brand_name", "class_type", "net_contents", "producer_info")


@query("SELECT p_partkey, '750 mL' AS net_contents FROM part")
def q17_labeled_field(spark, d):
    return D.labeled_fields(_forms(spark, d), ["p_partkey"], fields=("net_contents",)).select("p_partkey", "net_contents")


@query(with_views("SELECT label_id, CASE label_id % 6 WHEN 0 THEN 'Old River Distilling Co, Frankfort, KY 40601' WHEN 1 THEN 'Hill Cellars, 12 Main Street, Napa, California' WHEN 2 THEN 'Granite Brewing LLC, Portland, Maine 04101' WHEN 3 THEN 'North Import Inc, Edinburgh, Scotland' WHEN 4 THEN 'Maison Claire, Reims, France'"
       # Nobody has no address end: lines are taken up to the next field, or five of them.
       " ELSE 'Nobody' || CASE label_id % 4 WHEN 3 THEN ' Domestic GOVERNMENT WARNING: drink less ' || regexp_extract(raw_text, '[^\\n]*$') ELSE '' END END AS producer FROM label_text", "label_text"))
def q12_producer_lines(spark, d):
    return view(spark, d, "label_text").select("label_id", D.extract_producer(F.col("raw_text")).alias("producer"))


@query(with_views("", "photo_results") + SUMMARY + ", l AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN 'brand_name' ELSE 'net_contents' END AS field_key, run_id // 2 AS record FROM summary) SELECT record, coalesce(nullif(max(CASE WHEN field_key = 'brand_name' THEN value END), ''), max(CASE WHEN field_key = 'brand_name' THEN expected END)) AS brand_name, CASE WHEN bool_and(status = 'match') THEN 'pass' ELSE 'needs_review' END AS overall_status FROM l GROUP BY record")
def q33_saved_header(spark, d):
    fields = _summary(spark, d).withColumn("field_key", F.when(F.col("run_id") % 2 == 0, "brand_name").otherwise("net_contents")).withColumn("record", F.floor(F.col("run_id") / 2))
    return S.saved_headers(fields, ["record"])


@query(with_views("", "photo_results") + SUMMARY + " SELECT run_id, status, value, source_index FROM summary")
def q34_json_roundtrip(spark, d):
    text = S.encode_results(F.struct("status", "value", "source_index"))
    back = S.decode_results(F.col("results_json"), "status string, value string, source_index int")
    return _summary(spark, d).select("run_id", text.alias("results_json")).select("run_id", back.alias("r")).select("run_id", "r.*")


EDIT = "CASE p_partkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'none' END"


@query(with_views(f"SELECT id, name, CASE WHEN id % 5 = 1 THEN 'New ' || brand_name ELSE brand_name END AS brand_name, CASE WHEN id % 5 = 1 THEN NULL ELSE net_contents END AS net_contents, CASE WHEN id % 5 = 1 THEN '2024-02-02 00:00:00' ELSE '2024-01-01 00:00:00' END AS updated_at FROM library WHERE id % 5 <> 0 UNION ALL SELECT (SELECT max(id) FROM library) + s_suppkey - (SELECT min(s_suppkey) FROM supplier) + 1 AS id, s_name AS name, NULL AS brand_name, NULL AS net_contents, '2024-02-02 00:00:00' AS updated_at FROM supplier", "library"))
def q35_library_upsert(spark, d):
    first, later = "2024-01-01 00:00:00", "2024-02-02 00:00:00"
    rows = view(spark, d, "library").select("id", "name", *REFERENCE_FIELDS, F.lit(first).alias("created_at"), F.lit(first).alias("updated_at"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"))
    none = [F.lit(None).cast("string").alias(f) for f in REFERENCE_FIELDS[1:]]
    edits = rows.where("id % 5 < 2").select(F.when(F.col("id") % 5 == 0, "delete").otherwise("update").alias("action"), F.col("id").alias("seq"), "id", "name", F.concat(F.lit("New "), "brand_name").alias("brand_name"), *none)
    new = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("insert").alias("action"), F.col("s_suppkey").alias("seq"), F.lit(None).cast("long").alias("id"), F.col("s_name").alias("name"), F.lit(" ").alias("brand_name"), *none)
    top = rows.agg(F.max("id")).first()[0] or 0
    changed = S.next_versions(rows, edits.unionByName(new), 2, later, top)
    return S.latest(rows.unionByName(changed)).select("id", "name", "brand_name", "net_contents", "updated_at")


@query("SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type AS text FROM part")
def q36_docx_text(spark, d):
    lines = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("lines"))
    files = lines.select(F.col("p_partkey").cast("string").alias("path"), F.lit("docx").alias("kind"), docx_file(F.col("lines")).alias("content"))
    return texts_of(files).select(F.col("path").cast("long").alias("p_partkey"), "text")


@query()
def q37_heading_bold(spark, d):
    """A strip of a photo for each part: a heading of solid boxes, and body words with more or less ink."""
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("photo_id"), (F.col("p_size") % 3 + 1).cast("int").alias("gap"))
    word = F.posexplode(F.array(F.lit("GOVERNMENT"), F.lit("WARNING:"), *(F.lit(f"body{k}") for k in range(6)))).alias("word_seq", "text")
    words = parts.select("photo_id", word).select("*", (F.col("word_seq") * 16).alias("left"), F.lit(0).alias("top"), F.lit(16).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("block_num"))
    dark, light = F.lit("00"), F.lit("FF")
    solid = F.concat(F.repeat(dark, 8), F.repeat(light, 8))
    thin = F.substring(F.repeat(F.concat(dark, F.repeat(light, F.col("gap"))), 16), 1, 32)
    row = F.concat(F.repeat(solid, 2), F.repeat(thin, 6))
    tiles = parts.select("photo_id", F.lit(128).alias("w"), F.lit(8).alias("h"), F.unhex(F.repeat(row, 8)).alias("px"))
    return heading_bold(word_density(words, tiles))


# ---- whole runs ---------------------------------------------------------------------------------


MADE_WARNING = f"CASE p_size % 4 WHEN 0 THEN '{WARNING}' WHEN 1 THEN NULL WHEN 2 THEN substr('{WARNING}', 21, 60) ELSE '0000' END"
LABELS = f"""labels7 AS (SELECT l.id, r.*, l.brand_name AS expected_brand_name, l.class_type AS expected_class_type, l.alcohol_content AS expected_alcohol_content,
 l.net_contents AS expected_net_contents, l.producer_info AS expected_producer_info, l.country_of_origin AS expected_country_of_origin,
 {MADE_WARNING} AS health_warning_text, '{WARNING}' AS expected_health_warning_text
 FROM library l JOIN part ON p_partkey = l.id JOIN readings r ON r.photo_id = l.id % (SELECT count(*) FROM readings) + 1)"""


def _field_sql(field: str) -> str:
    """Rows of labels7 for a field: the comparison is joined by its two values."""
    if field == "health_warning_text":
        plain, whole = norm("health_warning_text"), norm("expected_health_warning_text")
        score = f"CASE WHEN contains({whole}, {plain}) THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
        return f"SELECT id, '{field}' AS field_key, health_warning_text AS extracted, expected_health_warning_text AS expected, CASE WHEN {blank('health_warning_text')} THEN 'not_found' WHEN {score} >= 80 THEN 'match' ELSE 'mismatch' END AS status, CASE WHEN {blank('health_warning_text')} THEN NULL ELSE {score} END AS score FROM labels7"
    void = f"({blank('x')} OR {blank('e')})"
    return f"SELECT id, '{field}' AS field_key, {field} AS extracted, expected_{field} AS expected, c.status, CASE WHEN {void} THEN NULL ELSE round(c.score, 6) END AS score FROM labels7 JOIN {field}_c c ON c.x IS NOT DISTINCT FROM {field} AND c.e IS NOT DISTINCT FROM expected_{field}"


@query(with_views("", "library", "readings") + ", " + LABELS + ", " + ", ".join(map(_field_cte, REFERENCE_FIELDS)) + " " + " UNION ALL ".join(map(_field_sql, FIELDS)))
def q38_compare_product(spark, d):
    """All seven fields of every label, a row for each field."""
    library = view(spark, d, "library").select("id", *(F.col(f).alias(f"expected_{f}") for f in REFERENCE_FIELDS))
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(MADE_WARNING).alias("health_warning_text"), F.lit(WARNING).alias("expected_health_warning_text"))
    readings = view(spark, d, "readings")
    rows = library.join(parts, "id").withColumn("photo_id", F.col("id") % readings.count() + 1).join(readings, "photo_id")
    return C.compare_product(rows, ["id"]).withColumn("score", F.round("score", 6))


def _expected(spark, d):
    best = M.best_matches(view(spark, d, "readings"), view(spark, d, "library"))
    return M.expected_values(view(spark, d, "photos"), best, view(spark, d, "library"), view(spark, d, "applications"))


def expected_sql(select: str) -> str:
    picks = ", ".join(f"CASE WHEN mode IN ('auto', 'product') THEN l.{f} WHEN mode = 'cola' THEN a.{f} ELSE nullif(trim(typed_{f}), '') END AS expected_{f}" for f in REFERENCE_FIELDS)
    made = f"expected AS (SELECT p.*, l.id AS product_id, l.name AS product_name, {picks}, '{WARNING}' AS expected_health_warning_text FROM photos p LEFT JOIN best b ON b.photo_id = p.photo_id LEFT JOIN library l ON l.id = CASE mode WHEN 'auto' THEN b.product_id WHEN 'product' THEN chosen_id END LEFT JOIN applications a ON a.run_id = p.run_id)"
    views = with_views("", "photos", "applications").removeprefix("WITH ").rstrip()
    return best_sql("*").removesuffix(" SELECT * FROM best") + f", {views}, {made} SELECT {select} FROM expected"


@query(expected_sql("photo_id, product_id, product_name, " + ", ".join(f"expected_{f}" for f in FIELDS)))
def q39_expected_values(spark, d):
    return _expected(spark, d).select("photo_id", "product_id", "product_name", *(f"expected_{f}" for f in FIELDS))


GROUPED = "CASE WHEN product_id IS NOT NULL THEN 'product:' || CAST(product_id AS STRING) WHEN mode = 'cola' THEN 'cola' ELSE 'standalone:' || CAST(index AS STRING) END"


@query(expected_sql(f"run_id, {GROUPED} AS group_key, CAST(row_number() OVER (PARTITION BY run_id ORDER BY min(index)) AS INT) AS place, CASE WHEN min(product_id) IS NOT NULL THEN min_by(product_name, index) WHEN min(mode) = 'cola' THEN 'COLA Application' ELSE 'Label ' || CAST(min(index) + 1 AS STRING) END AS label, count(*) AS photos, CASE bool_or(caps_ok) WHEN true THEN 'true' WHEN false THEN 'false' ELSE '' END AS caps_ok, CASE bool_or(bold_ok) WHEN true THEN 'true' WHEN false THEN 'false' ELSE '' END AS bold_ok") + f" GROUP BY run_id, {GROUPED}")
def q40_group_headers(spark, d):
    headers = V.group_headers(_expected(spark, d))
    return headers.select("run_id", "group_key", "place", "label", "photos", V.encode_tristate(F.col("caps_ok")).alias("caps_ok"), V.encode_tristate(F.col("bold_ok")).alias("bold_ok"))


def _compared_run(spark, d):
    """Every photo of every run against its reference, in long form, with its group."""
    readings = view(spark, d, "readings").drop("run_id").withColumn("health_warning_text", F.when(F.col("photo_id") % 3 > 0, WARNING))
    photos = _expected(spark, d).join(readings, "photo_id").withColumn("group_key", V.group_key(F.col("product_id"), F.col("mode"), F.col("index")))
    # Read several times below: written once, as the matching before it is costly.
    compared = C.compare_product(kept_table(photos, "run-photos"), ["run_id", "group_key", "index"], broad_class=F.col("mode") == "cola")
    return kept_table(compared, "run-comparisons")


@query()
def q41_run_summary(spark, d):
    """Each group's seven fields; tests hold it against a plain version."""
    return V.group_summary(_compared_run(spark, d), ["run_id", "group_key"], readings=False)


def _saved(spark, d):
    """Version rows of saved verifications: a record for each group of photo results, its fields by the run's parity."""
    # Both are read several times below: written once, as is what the summary reads.
    results = kept_table(view(spark, d, "photo_results").withColumn("field_key", F.lit("net_contents")), "photo-results")
    fields = kept_table(V.group_summary(results, ["run_id"], fields=("net_contents",)), "summaries")
    drop_table(results)
    fields = fields.withColumn("field_key", F.when(F.col("run_id") % 2 == 0, "brand_name").otherwise("net_contents")).withColumn("record", F.floor(F.col("run_id") / 2))
    fields = fields.withColumn("computed_status", F.lit(None).cast("string")).withColumn("manual_override", F.lit(False))
    marks = fields.select("record").distinct().select("record", (F.col("record") % 2 == 0).alias("caps_ok"), F.lit(None).cast("boolean").alias("bold_ok"))
    none = F.lit(None).cast("map<string,string>")
    compared = F.lit(None).cast("map<string,struct<status:string,extracted_value:string,expected_value:string,score:double>>")
    photo = F.struct(F.lit(0).alias("index"), F.concat(F.lit("text "), F.col("record").cast("string")).alias("raw_text"), none.alias("extracted"), none.alias("expected"), compared.alias("comparisons_by_field"), F.col("caps_ok").alias("warning_caps_ok"), F.col("bold_ok").alias("warning_bold_ok"))
    results = S.results_of(fields, ["record"], marks, marks.select("record", photo.alias("photo")))
    return S.saved_headers(fields, ["record"]).join(results, "record")


@query(with_views("", "photo_results") + SUMMARY + """, l AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN 'brand_name' ELSE 'net_contents' END AS field_key, run_id // 2 AS record FROM summary),
hh AS (SELECT row_number() OVER (ORDER BY record) AS id, record, coalesce(nullif(max(CASE WHEN field_key = 'brand_name' THEN value END), ''), max(CASE WHEN field_key = 'brand_name' THEN expected END)) AS brand_name, CASE WHEN bool_and(status = 'match') THEN 'pass' ELSE 'needs_review' END AS overall_status, max(CASE WHEN field_key = 'net_contents' THEN status END) AS net_status FROM l GROUP BY record)
SELECT id, 'file ' || CAST(record AS STRING) || '.docx' AS source_filename, CASE WHEN id % 3 = 1 THEN 'Corrected' ELSE brand_name END AS brand_name, CASE WHEN id % 3 = 1 THEN 'pass' ELSE overall_status END AS overall_status, '2024-01-01 00:00:00' AS created_at, CASE WHEN id % 3 = 1 THEN '2024-02-02 00:00:00' ELSE '2024-01-01 00:00:00' END AS updated_at,
 net_status, record % 2 = 0 AS caps_ok, 'text ' || CAST(record AS STRING) AS raw_text FROM hh WHERE id % 3 <> 0""")
def q42_saved_verifications(spark, d):
    """Verifications that are inserted, corrected and deleted, read back by id with their payload; the second batch of edits is by id."""
    first, later = "2024-01-01 00:00:00", "2024-02-02 00:00:00"
    none = F.lit(None).cast("string")
    inserts = _saved(spark, d).select(F.lit("insert").alias("action"), F.col("record").alias("seq"), F.lit(None).cast("long").alias("id"), F.concat(F.lit("file "), F.col("record").cast("string"), F.lit(".docx")).alias("source_filename"), "brand_name", "overall_status", "results_json")
    stored = kept_table(S.next_verifications(S.empty_store(spark, S.VERIFICATION), inserts, 1, first, 0), "verifications")
    edits = stored.select(F.expr("CASE id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'keep' END").alias("action"), F.col("id").alias("seq"), "id", none.alias("source_filename"), F.lit("Corrected").alias("brand_name"), F.lit("pass").alias("overall_status"), "results_json")
    changed = S.next_verifications(stored, edits, 2, later, stored.count())
    found = S.by_id(stored.unionByName(changed), stored.select("id"))
    read = S.decode_results(F.col("results_json"), S.RESULTS)
    return found.select("id", "source_filename", "brand_name", "overall_status", "created_at", "updated_at", read["field_summary"]["net_contents"]["status"].alias("net_status"), read["warning_caps_ok"].alias("caps_ok"), F.get(read["photos"], F.lit(0))["raw_text"].alias("raw_text"))


@query(f"""WITH e AS (SELECT event_id, user_id % 50 AS batch_id, 'f' || CAST(event_id AS STRING) AS filename, {FOLD.format(KEY)} AS k, event_type = 'click' AS bad FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY k, bad ORDER BY event_id) AS n FROM e), g AS (SELECT *, NOT bad AND NOT (k = '' OR (n = 1 AND k NOT IN (SELECT {FOLD.format('c_name')} FROM customer))) AS twice FROM f)
SELECT batch_id, count(*) FILTER (WHERE NOT bad AND NOT twice) AS saved, count(*) FILTER (WHERE twice) AS duplicates, count(*) FILTER (WHERE bad) AS failed, coalesce(array_to_string(list(filename ORDER BY filename) FILTER (WHERE twice), ','), '') AS duplicate_names FROM g GROUP BY batch_id""")
def q43_batch_counts(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    docs = events.select(F.col("event_id").alias("doc_id"), (F.col("user_id") % 50).alias("batch_id"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("filename"), F.expr(KEY).alias("brand"), F.when(F.col("event_type") == "click", "unreadable").alias("error"))
    known = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("key"))
    kept = M.first_of_each(docs.where("error IS NULL"), F.col("brand"), ["doc_id"], known)
    return M.batch_counts(docs, kept).select("batch_id", "saved", "duplicates", "failed", F.array_join("duplicate_names", ",").alias("duplicate_names"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS shown, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS back, CAST(CAST(round_even(p_retailprice / 10, 0) AS INT) AS STRING) || '%' AS score FROM part")
def q44_tristate_and_score(spark, d):
    mark = F.expr("CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END")
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", V.encode_tristate(mark).alias("shown"), C.score_shown(F.col("p_retailprice") / 10).alias("score"))
    return rows.select("p_partkey", "shown", V.decode_tristate(F.col("shown")).alias("back"), "score")


@query("SELECT CAST(p_partkey AS STRING) AS path, CAST(0 AS INT) AS number, CAST(100 + p_size * 5 AS INT) AS width, CAST(160 AS INT) AS height FROM part WHERE p_partkey % 3 > 0 AND least(100 + p_size * 5, 160) >= 150 UNION ALL SELECT CAST(p_partkey AS STRING), CAST(1 AS INT), CAST(200 AS INT), CAST(150 AS INT) FROM part WHERE p_partkey % 3 > 0")
def q45_document_images(spark, d):
    """Photos inside documents: by relationships, large enough; a third of the files are broken."""
    png = lambda w, h: F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(w), 8, "0")), F.unhex(F.lpad(F.hex(h), 8, "0")))
    parts = dealt_parts(spark, d).select(F.col("p_partkey").cast("string").alias("path"), F.array(png(100 + F.col("p_size") * 5, F.lit(160)), png(F.lit(200), F.lit(150)), png(F.lit(149), F.lit(900))).alias("photos"), (F.col("p_partkey") % 3 > 0).alias("sound"))
    files = parts.select("path", F.lit("docx").alias("kind"), F.when(F.col("sound"), docx_file(F.array(F.lit("x")), F.col("photos"))).otherwise(F.lit(b"no file")).alias("content"))
    return images_of(files).select("path", "number", "width", "height")


@query()
def q46_label_fields(spark, d):
    """All seven fields of every photo, from its words' places and its text."""
    texts = view(spark, d, "label_text").select(F.col("label_id").alias("photo_id"), "raw_text")
    return L.label_fields(view(spark, d, "ocr_words"), texts)


@query(with_views("SELECT id AS product_id, name, row_number() OVER (ORDER BY translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id) AS place FROM library", "library"))
def q47_product_scan(spark, d):
    """Products with their places in the order of names."""
    rows = view(spark, d, "library").select(F.col("id").alias("product_id"), "name", F.struct(M.candidate_order(F.col("name")).alias("name_key"), "id").alias("key"))
    return S.numbered(rows, 0, "key").select("product_id", "name", F.col("id").alias("place"))


@query("SELECT o_orderkey AS id, 'f' AS source_filename, 'b' AS brand_name, CAST(o_orderstatus AS STRING) AS overall_status, CAST(o_totalprice AS STRING) AS created_at, '' AS updated_at FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0)".replace("CAST(o_totalprice AS STRING)", "'2024-01-' || lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')"))
def q48_saved_list(spark, d):
    """Headers of all saved records that weren't deleted, newest first."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("o_orderkey") % 28 + 1).cast("string"), 2, "0"))
    stored = orders.select(F.col("o_orderkey").alias("id"), F.lit("f").alias("source_filename"), F.lit("b").alias("brand_name"), F.col("o_orderstatus").alias("overall_status"), F.lit("{}").alias("results_json"), day.alias("created_at"), F.lit("").alias("updated_at"), F.lit(1).alias("version"), (F.col("o_orderkey") % 2 == 1).alias("deleted"))
    return S.newest_first(S.latest(stored))


@query("SELECT s_suppkey AS id, coalesce(CASE s_suppkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN NULLIF('', '') END, s_name) AS name FROM supplier")
def q49_merge_extracted(spark, d):
    extracted = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN '' END")
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), S.merge_extracted(F.col("s_name"), extracted).alias("name"))


@query(f"""WITH e AS (SELECT event_id, {FOLD.format(KEY)} AS k, event_type = 'click' AS bad FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY k, bad ORDER BY event_id) AS n FROM e)
SELECT event_id AS doc_id, CASE WHEN bad THEN 'failed' WHEN k = '' OR (n = 1 AND k NOT IN (SELECT {FOLD.format('c_name')} FROM customer)) THEN 'saved' ELSE 'duplicate' END AS outcome FROM f""")
def q52_stream_dedup(spark, d):
    """The documents of q43 as a stream of four drops in the order of their ids, with the brands claimed in keyed state."""
    events = spark.read.parquet(f"{d}/events.parquet")
    docs = events.select(F.col("event_id").alias("doc_id"), (F.col("user_id") % 50).alias("batch_id"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("filename"), F.expr(KEY).alias("brand"), F.when(F.col("event_type") == "click", "unreadable").alias("error"))
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    folder = scratch_path(spark, "arrivals")
    drop = F.floor((F.col("doc_id") - (least or 0)) * 4 / ((most or 0) - (least or 0) + 1))
    for k in range(4):
        docs.where(drop == k).coalesce(1).write.mode("append").parquet(f"{folder}/drops")
    arrivals = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/drops")
    known = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("key"))
    return run_arrivals(arrivals, folder, known).select("doc_id", "outcome")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN p_name || chr(10) || p_type END AS text, CASE WHEN p_partkey % 10 = 0 THEN 'Unsupported document type: .txt' END AS error FROM part")
def q54_document_files(spark, d):
    """A DOCX file for each part, one in ten with another extension, written to folders of some thousands and read back."""
    folder = scratch_path(spark, "documents")
    parts = dealt_parts(spark, d)
    name = F.concat(F.floor(F.col("p_partkey") / 4096).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 10 == 0, ".txt").when(F.col("p_partkey") % 10 == 1, ".DOCX").otherwise(".docx"))
    kept_table(write_files(parts.select(name.alias("name"), docx_file(F.array("p_name", "p_type")).alias("content")), folder), "written-files")
    return read_folders(spark, folder).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("p_partkey"), "text", "error")


EDITED = "CASE o_custkey % 3 WHEN 0 THEN ' 750 mL' WHEN 1 THEN '2 L' ELSE '  ' END"
CHANGED = "CASE o_orderstatus WHEN 'F' THEN 'match' WHEN 'O' THEN 'mismatch' ELSE '' END"
FULL = with_views("", "photo_results").replace("photo_results AS (", "stored AS (", 1) + f""", edits AS (SELECT o_orderkey AS run_id, nullif(trim({EDITED}), '') AS v FROM orders WHERE o_custkey % 10 = 0),
photo_results AS (SELECT s.run_id, s.index, CASE WHEN e.run_id IS NULL THEN extracted ELSE v END AS extracted, expected, CASE WHEN e.run_id IS NULL THEN status WHEN v IS NULL THEN 'not_found' WHEN v = '750 mL' THEN 'match' ELSE 'mismatch' END AS status
  FROM stored s LEFT JOIN edits e ON e.run_id = s.run_id AND s.index = 1)"""


@query(FULL + SUMMARY + f", o AS (SELECT o_orderkey AS run_id, nullif({CHANGED}, '') AS override FROM orders WHERE o_custkey % 10 < 2) SELECT s.run_id, coalesce(o.override, s.status) AS status, s.value, s.source_index, s.n_values, CASE WHEN o.override IS NOT NULL THEN s.status END AS computed_status, o.override IS NOT NULL AS manual_override FROM summary s LEFT JOIN o USING (run_id)")
def q53_redecide(spark, d):
    """All decisions after a list of edits (the first photo of every tenth customer's orders) and overrides, worked out anew only where they touch."""
    stored = view(spark, d, "photo_results").withColumn("field_key", F.lit("net_contents"))
    decided = kept_table(R.undecided(V.group_summary(stored, ["run_id"], fields=("net_contents",), readings=False)), "decided")
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderkey", "run_id")
    there = stored.where("index = 1").select("run_id", "index", "expected")
    edits = orders.where("o_custkey % 10 = 0").join(there, "run_id").select("run_id", "index", F.lit("net_contents").alias("field_key"), F.expr(EDITED).alias("extracted"), "expected")
    changes = orders.where("o_custkey % 10 < 2").select("run_id", F.lit("net_contents").alias("field_key"), F.expr(CHANGED).alias("override"))
    new = R.redecided(stored, decided, edits, changes.join(decided.select("run_id"), "run_id", "left_semi"), ["run_id"], fields=("net_contents",))
    return R.with_new(decided, new, ["run_id"]).select("run_id", "status", "value", "source_index", "n_values", "computed_status", "manual_override")


SUBMITTED = """SELECT CASE s_suppkey % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'create' ELSE 'new' END AS action, s_suppkey AS seq, s_suppkey * 30 AS product_id,
 CASE s_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE ' ' || s_name || ' ' END AS name, ' Corrected ' AS brand_name, CASE s_suppkey % 5 WHEN 0 THEN '  ' ELSE 'Vodka' END AS class_type,
 '40% ALC/VOL' AS alcohol_content, CAST(NULL AS STRING) AS net_contents, 'Oak Co, Napa, CA' AS producer_info, '' AS country_of_origin FROM supplier"""


@query(with_views(f", s AS ({SUBMITTED}), made AS (SELECT (SELECT max(id) FROM library) + row_number() OVER (ORDER BY seq) AS id, * FROM s WHERE action <> 'update' AND trim(coalesce(name, '')) <> ''), u AS (SELECT s.* FROM s JOIN library l ON l.id = s.product_id WHERE action = 'update') "
       "SELECT l.id, l.name, CASE WHEN u.seq IS NULL THEN l.brand_name ELSE trim(u.brand_name) END AS brand_name, CASE WHEN u.seq IS NULL THEN l.class_type ELSE nullif(trim(u.class_type), '') END AS class_type, CASE WHEN u.seq IS NULL THEN l.net_contents END AS net_contents, CASE WHEN u.seq IS NULL THEN l.country_of_origin END AS country_of_origin, CASE WHEN u.seq IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-02-02 00:00:00' END AS updated_at FROM library l LEFT JOIN u ON u.product_id = l.id "
       "UNION ALL SELECT id, trim(name), trim(brand_name), nullif(trim(class_type), ''), NULL, NULL, '2024-02-02 00:00:00' FROM made", "library").replace("part ,", "part,").replace(") , s AS", "), s AS"))
def q50_upsert_of_run(spark, d):
    """The library after a run's corrected values: products updated under their stored names, created, or refused."""
    first, later = "2024-01-01 00:00:00", "2024-02-02 00:00:00"
    library = view(spark, d, "library")
    rows = library.select("id", "name", *REFERENCE_FIELDS, F.lit(first).alias("created_at"), F.lit(first).alias("updated_at"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"))
    spark.read.parquet(f"{d}/supplier.parquet").createOrReplaceTempView("supplier")
    changed = S.upsert_of_run(rows, spark.sql(SUBMITTED), 2, later, rows.agg(F.max("id")).first()[0] or 0)
    return S.latest(rows.unionByName(changed)).select("id", "name", "brand_name", "class_type", "net_contents", "country_of_origin", "updated_at")


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
