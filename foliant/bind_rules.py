"""Queries over rule scores, extractions, theta joins and nested data on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog import query
from foliant.model import table
from foliant.operators import rules, stories, workbook

DOC = "documents"


def _sql_hits(low: str, words: list[str]) -> str:
    return "(" + " + ".join("contains({}, '{}')::INTEGER".format(low, w.replace("'", "''")) for w in words) + ")"


_COUNTS = ", ".join(f"{_sql_hits('low', words)} AS c{k}" for k, words in enumerate(rules.DOMAINS.values()))
_MOST = "greatest(" + ", ".join(f"c{k}" for k in range(len(rules.DOMAINS))) + ")"
_FIRST = " ".join(f"WHEN c{k} = {_MOST} THEN '{name}'" for k, name in enumerate(rules.DOMAINS))


@query(f"WITH q AS (SELECT page_id, lower(html) AS low FROM pages), c AS (SELECT page_id, {_COUNTS} FROM q) SELECT page_id, CASE WHEN {_MOST} = 0 THEN 'style' {_FIRST} END AS domain FROM c")
def domain_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.domain_of(F.col("html")).alias("domain"))


_ASKED = ["the", "idiot", "the", "thinor"]


def _bm25_sql() -> str:
    unique = list(dict.fromkeys(_ASKED))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(unique))
    n = ", ".join(f"count(*) FILTER (tf{k} > 0) AS n{k}" for k in range(len(unique)))
    part = " + ".join(f"{_ASKED.count(t)} * CASE WHEN tf{k} > 0 THEN ln((n - n{k} + 0.5) / (n{k} + 0.5) + 1) * tf{k} * 2.5 / (tf{k} + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for k, t in enumerate(unique))
    return f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2) AS w FROM documents), t AS (SELECT doc_id, len(w)::DOUBLE AS dl, {tf} FROM w), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {n} FROM t), r AS (SELECT doc_id, {part} AS score FROM t, s ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0"""


@query(_bm25_sql())
def bm25_csv(spark, sf_dir):
    return rules.bm25_plain(table(spark, sf_dir, DOC), "doc_id", "text", _ASKED).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'green') THEN 10 WHEN contains(lower(p_type), 'green') THEN 3 WHEN contains(lower(p_brand), 'green') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), 'brand#1') THEN 10 WHEN contains(lower(p_type), 'brand#1') THEN 3 WHEN contains(lower(p_brand), 'brand#1') THEN 1 ELSE 0 END)::INTEGER AS points FROM part ORDER BY points DESC, p_partkey LIMIT 20")
def best_match(spark, sf_dir):
    points = rules.best_match_points(F.col("p_name"), F.col("p_type"), F.col("p_brand"), ["Green", "brand#1"])
    return table(spark, sf_dir, "part").select("p_partkey", points.alias("points")).orderBy(F.desc("points"), "p_partkey").limit(20)


_DIV = "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 100 END AS payout, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey - 5.0 END AS growth, (c_custkey % 40)::INTEGER AS years, c_custkey % 12 + 0.5 AS dy FROM customer"


@query(f"""WITH d AS ({_DIV}), s AS (SELECT c_custkey, payout, greatest(0, least(100, 50 + CASE WHEN payout IS NULL THEN 0 WHEN payout < 40 THEN 20 WHEN payout < 60 THEN 10 WHEN payout < 80 THEN -10 ELSE -20 END + CASE WHEN growth IS NULL THEN 0 WHEN growth > 10 THEN 15 WHEN growth > 5 THEN 10 WHEN growth > 0 THEN 5 ELSE -15 END + CASE WHEN years >= 25 THEN 15 WHEN years >= 10 THEN 10 WHEN years >= 5 THEN 5 ELSE 0 END + CASE WHEN dy > 8 THEN -10 ELSE 0 END))::INTEGER AS score FROM d)
SELECT c_custkey, CASE WHEN payout IS NULL THEN 'unknown' WHEN payout < 40 THEN 'safe' WHEN payout < 60 THEN 'moderate' WHEN payout < 80 THEN 'high' ELSE 'unsustainable' END AS status, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'moderate' ELSE 'poor' END AS rating FROM s""")
def dividend_safety(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    d = c.select(key, F.when(key % 11 != 0, F.col("c_acctbal") / 100).alias("payout"), F.when(key % 7 != 0, F.col("c_nationkey") - 5.0).alias("growth"), (key % 40).cast("int").alias("years"), (key % 12 + 0.5).alias("dy"))
    score = rules.safety_score(F.col("payout"), F.col("growth"), F.col("years"), F.col("dy"))
    return d.select("c_custkey", rules.payout_status(F.col("payout")).alias("status"), score.cast("int").alias("score"), rules.income_rating(score).alias("rating"))


_KIND = "CASE doc_id % 6 WHEN 0 THEN 'ma' WHEN 1 THEN 'insider' WHEN 2 THEN 'analyst' WHEN 3 THEN 'regulatory' WHEN 4 THEN 'earnings' ELSE 'other' END"


@query(f"WITH r AS (SELECT doc_id, {_KIND} AS kind, lower(text) AS low, doc_id % 4 = 0 AS engaged FROM documents) SELECT doc_id, least(10, 1 + CASE kind WHEN 'ma' THEN 5 WHEN 'insider' THEN 4 WHEN 'analyst' THEN 3 WHEN 'regulatory' THEN 3 WHEN 'earnings' THEN 2 ELSE 1 END + CASE WHEN regexp_matches(low, 'breaking|just in|alert|urgent') THEN 2 ELSE 0 END + CASE WHEN engaged THEN 2 ELSE 0 END)::INTEGER AS score FROM r")
def rumor_impact(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in (*rules.RUMORS, "other")])
    return table(spark, sf_dir, DOC).select("doc_id", rules.impact_score(F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")), F.col("text"), F.col("doc_id") % 4 == 0).cast("int").alias("score"))


@query("WITH m AS (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS name FROM documents) SELECT name, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def top_mentions(spark, sf_dir):
    names = table(spark, sf_dir, DOC).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{4,})"), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query("SELECT event_type, user_id % 3 AS severity, count(*) AS n FROM events GROUP BY ALL")
def issue_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT user_id, round(avg((event_type = 'purchase')::INTEGER), 6) AS rate, avg((event_type = 'purchase')::INTEGER) >= 0.2 AS passed FROM events GROUP BY 1")
def trigger_rate(spark, sf_dir):
    rate = F.avg((F.col("event_type") == "purchase").cast("int"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(rate, 6).alias("rate"), (rate >= 0.2).alias("passed"))


_WORDS = ["the", "and", "idiot", "pour", "nicht"]


@query(f"SELECT doc_id, {_sql_hits('lower(text)', _WORDS)} / 5.0::DOUBLE AS coverage, array_to_string(list_filter(['the','and','idiot','pour','nicht'], lambda x: NOT contains(lower(text), x)), ',') AS missing FROM documents")
def keyword_coverage(spark, sf_dir):
    missing = F.filter(F.array(*[F.lit(w) for w in _WORDS]), lambda w: ~F.contains(F.lower("text"), w))
    return table(spark, sf_dir, DOC).select("doc_id", rules.coverage(F.col("text"), _WORDS).alias("coverage"), F.array_join(missing, ",").alias("missing"))


@query("SELECT p_partkey, n_nationkey FROM part JOIN nation ON contains(lower(p_name), lower(left(n_name, 2))) OR contains(lower(n_name), lower(p_name))")
def theta_contains_join(spark, sf_dir):
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # nations are a fixed small set
    either = F.contains(F.lower("p_name"), F.lower(F.substring("n_name", 1, 2))) | F.contains(F.lower("n_name"), F.lower("p_name"))
    return p.join(F.broadcast(n), either).select("p_partkey", "n_nationkey")


_NAMES = "SELECT DISTINCT regexp_extract(lower(text), '[a-z]+') AS name FROM benchmark WHERE regexp_matches(lower(text), '[a-z]')"


@query(rf"WITH k AS ({_NAMES}), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS word FROM documents) SELECT doc_id, name FROM w JOIN k ON word = name")
def known_mentions(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("name"))
    return stories.mentions(table(spark, sf_dir, DOC), "doc_id", "text", names)


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND d.source IS NOT NULL)")
def undefined_names(spark, sf_dir):
    docs = table(spark, sf_dir, DOC).select("doc_id", "source")
    defined = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("source")
    return rules.undefined(docs, defined, "source")


_RULES = "SELECT rule, row_number() OVER (ORDER BY rule) AS rule_no FROM (SELECT DISTINCT split_part(upper(p_type), ' ', 1) AS rule FROM part)"


@query(f"WITH r AS ({_RULES}), c AS (SELECT p_partkey, rule, CASE WHEN upper(p_type) = rule THEN 1 WHEN contains(upper(p_type), rule) THEN 2 WHEN contains(upper(p_name), left(rule, 3)) THEN 3 END AS stage, rule_no FROM part, r) SELECT p_partkey, arg_min(rule, stage * 1000 + rule_no) AS rule, min(stage)::INTEGER AS stage FROM c WHERE stage IS NOT NULL GROUP BY 1")
def fallback_rule_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = part.select(F.get(F.split(F.upper("p_type"), " "), 0).alias("rule")).distinct()
    return rules.match_rules(part.select("p_partkey", F.upper("p_type").alias("exact"), F.upper("p_name").alias("more")), "p_partkey", "exact", "more", known)


_SCHOOLS = "SELECT l_partkey, l_suppkey, 'school-' || min(l_orderkey) AS rec FROM lineitem WHERE l_quantity >= 45 GROUP BY ALL"
_MAJORS = "SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, 'major-' || min(l_orderkey) AS rec FROM lineitem WHERE l_quantity < 10 GROUP BY ALL"


@query(f"WITH s AS ({_SCHOOLS}), m AS ({_MAJORS}) SELECT l.l_orderkey, l.l_linenumber, s.rec AS school_rec, m.rec AS major_rec FROM lineitem l LEFT JOIN s ON s.l_partkey = l.l_partkey AND s.l_suppkey = l.l_suppkey LEFT JOIN m ON m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag = l.l_returnflag AND m.l_linestatus = l.l_linestatus")
def composite_lookup(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    rec = lambda kind, where, *keys: l.where(where).groupBy(*keys).agg(F.concat(F.lit(kind), F.min("l_orderkey").cast("string")).alias("rec"))
    two, four = ["l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    out = rules.lookup_recs(l, {"school_rec": (two, rec("school-", "l_quantity >= 45", *two)), "major_rec": (four, rec("major-", "l_quantity < 10", *four))})
    return out.select("l_orderkey", "l_linenumber", "school_rec", "major_rec")


_CODE = "CASE c_custkey % 4 WHEN 0 THEN lpad(c_custkey::VARCHAR, 6, '0') WHEN 1 THEN lpad((c_custkey % 100000)::VARCHAR, 5, '0') || '.hk' WHEN 2 THEN c_name ELSE c_mktsegment END"


@query(rf"WITH k AS (SELECT c_custkey, {_CODE} AS code FROM customer) SELECT c_custkey, CASE WHEN regexp_full_match(code, '\d{{6}}') THEN 'CN' WHEN regexp_full_match(upper(code), '\d{{4,5}}\.HK') THEN 'HK' ELSE 'US' END AS market FROM k")
def market_detect(spark, sf_dir):
    key = F.col("c_custkey")
    code = F.when(key % 4 == 0, F.lpad(key.cast("string"), 6, "0")).when(key % 4 == 1, F.concat(F.lpad((key % 100000).cast("string"), 5, "0"), F.lit(".hk"))).when(key % 4 == 2, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.market_of(code).alias("market"))


_W = "SELECT p_partkey, p_retailprice AS price, p_retailprice * (0.8 + p_partkey % 5 * 0.1) AS added, 1500.0 + p_partkey % 7 AS target, 950.0 + p_partkey % 3 AS stop, CASE WHEN p_partkey % 4 > 0 THEN 'hold' END AS last, CASE p_partkey % 3 WHEN 0 THEN 'buy' ELSE 'hold' END AS signal FROM part"


@query(f"WITH w AS ({_W}) SELECT p_partkey, round((price - added) / added * 100, 2) AS change_pct, round((target - price) / price * 100, 2) AS to_target_pct, round((stop - price) / price * 100, 2) AS to_stop_pct, array_to_string(list_filter([CASE WHEN price >= target THEN 'target_hit' END, CASE WHEN price <= stop THEN 'stop_hit' END, CASE WHEN last IS NOT NULL AND signal <> last THEN 'signal_change' END], lambda x: x IS NOT NULL), ',') AS alerts FROM w")
def watch_alerts(spark, sf_dir):
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    w = table(spark, sf_dir, "part").select(key, price.alias("price"), (price * (F.lit(0.8) + key % 5 * 0.1)).alias("added"), (key % 7 + 1500.0).alias("target"), (key % 3 + 950.0).alias("stop"), F.when(key % 4 > 0, "hold").alias("last"), F.when(key % 3 == 0, "buy").otherwise("hold").alias("signal"))
    c = {n: F.col(n) for n in ("price", "added", "target", "stop", "last", "signal")}
    deltas = rules.watch_deltas(c["price"], c["added"], c["target"], c["stop"])
    return w.select("p_partkey", *[v.alias(k) for k, v in deltas.items()], F.array_join(rules.alerts(c["price"], c["target"], c["stop"], c["last"], c["signal"]), ",").alias("alerts"))


@query("WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS price, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1.0 END AS ma, c_custkey % 9 = 0 AS hot, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 2.0 END AS roe FROM customer) SELECT c_custkey, array_to_string(list_filter([CASE WHEN coalesce(price, 0) = 0 THEN 'price' END, CASE WHEN ma IS NULL THEN 'technical' END, CASE WHEN hot THEN 'overbought' END, CASE WHEN roe IS NULL THEN 'fundamental' END], lambda x: x IS NOT NULL), ',') AS warnings FROM q")
def quote_validation(spark, sf_dir):
    key = F.col("c_custkey")
    price, ma, roe = F.when(key % 5 == 0, 0.0).otherwise(F.col("c_acctbal")), F.when(key % 4 != 0, 1.0), F.when(key % 6 != 0, 2.0)
    return table(spark, sf_dir, "customer").select(key, F.array_join(rules.quote_warnings(price, ma, ma, key % 9 == 0, roe, roe), ",").alias("warnings"))


_NICE_SQL, _MUST_SQL = "|".join(rules.NICE), "|".join(rules.MUST)
_VERB_SQL = "(" + " OR ".join(f"contains(low, '{v}')" for v in rules.VERBS) + ")"


@query(f"WITH s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;\\n]+'), lambda x: regexp_replace(x, '^[ \\t\\-•·*]+|[ \\t\\-•·*]+$', '', 'g')), lambda x: x <> '')) AS sentence FROM conversations), k AS (SELECT conv_id, turn, lower(sentence) AS low FROM s) SELECT conv_id, turn, CASE WHEN regexp_matches(low, '{_NICE_SQL}') THEN 'nice' WHEN regexp_matches(low, '{_MUST_SQL}') THEN 'must' WHEN {_VERB_SQL} THEN 'responsibilities' ELSE 'others' END AS kind, count(*) AS n FROM k GROUP BY ALL")
def jd_classify(spark, sf_dir):
    one = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(rules.sentences(F.col("text"))).alias("sentence"))
    return one.groupBy("conv_id", "turn", rules.sentence_kind(F.col("sentence")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?m)^\s*[-*•]\s+')) AS bullets, len(regexp_extract_all(text, '\d+(?:\.\d+)?%?')) AS numbers FROM documents)
SELECT doc_id, greatest(0, 10 - CASE WHEN length(text) < 200 THEN 3 WHEN length(text) > 6000 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(text, '[0-9A-Za-z_.\-+]+@[0-9A-Za-z_.\-]+\.[0-9A-Za-z_]+') THEN 0 ELSE 1 END - CASE WHEN regexp_matches(text, '(\+?86[-\s]?)?1[3-9]\d{9}|\d{3}[-\s]?\d{4}[-\s]?\d{4}') THEN 0 ELSE 1 END
 - CASE WHEN len(regexp_extract_all(text, '[★☆●○◆◇▶▷■□▪▫♦]')) > 5 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(text, '[\x{1F300}-\x{1FAFF}]') THEN 1 ELSE 0 END - CASE WHEN bullets > 0 AND numbers::DOUBLE / nullif(bullets, 0) < 0.4 THEN 1 ELSE 0 END)::INTEGER AS score FROM t""")
def ats_score(spark, sf_dir):
    return table(spark, sf_dir, DOC).select("doc_id", rules.ats_score(F.col("text")).cast("int").alias("score"))


@query("WITH p AS (SELECT doc_id, text, instr(lower(text), 'pathetic')::INTEGER AS hit FROM documents), q AS (SELECT *, greatest(1, hit - 30) AS b FROM p) SELECT doc_id, trim(replace(substring(text, b, hit + 38 - b), chr(10), ' ')) AS evidence FROM q WHERE hit > 0")
def gap_evidence(spark, sf_dir):
    return table(spark, sf_dir, DOC).select("doc_id", rules.evidence(F.col("text"), "pathetic").alias("evidence")).where("evidence is not null")


def _resume(text):
    """Documents whose sentences become anchors and bullets: a sentence with 'of ' an anchor, others bullets."""
    return F.array_join(F.transform(F.split(text, r"\. "), lambda s: F.when(F.contains(s, F.lit("idiot")), F.concat(F.lit("A | "), s, F.lit(" | 2024"))).otherwise(F.concat(F.lit("- "), s))), "\n")


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents),
x AS (SELECT doc_id, i, unnest(string_split(CASE WHEN contains(s, 'idiot') THEN 'A | ' || s || ' | 2024' ELSE '- ' || s END, chr(10))) AS line, generate_subscripts(string_split(CASE WHEN contains(s, 'idiot') THEN 'A | ' || s || ' | 2024' ELSE '- ' || s END, chr(10)), 1) AS j FROM s),
l AS (SELECT doc_id, i, j, trim(line, ' ') AS line, regexp_matches(trim(line, ' '), '^[^\n]+?[|｜][^\n]+?[|｜][^\n]+$') AS a FROM x),
n AS (SELECT *, sum(a::INTEGER) OVER (PARTITION BY doc_id ORDER BY i, j) AS no FROM l)
SELECT doc_id, no::BIGINT AS no, arg_min(line, i * 1000 + j) AS title, count(*) FILTER (NOT a AND regexp_matches(line, '^[-*•]')) AS n_bullets FROM n WHERE no > 0 GROUP BY doc_id, no HAVING n_bullets > 0""")
def experience_segments(spark, sf_dir):
    return rules.segments(table(spark, sf_dir, DOC).select("doc_id", _resume(F.col("text")).alias("text")), "doc_id", "text", r"^[^\n]+?[|｜][^\n]+?[|｜][^\n]+$")


@query("WITH a AS (SELECT user_id, list((value / 100.0) % 1.0 ORDER BY event_id) AS h FROM events GROUP BY 1) SELECT user_id, len(h)::INTEGER AS attempts, list_reduce(list_prepend(1.0, h), lambda s, x: CASE WHEN x >= 0.6 THEN least(s + 1, 3) ELSE greatest(s - 1, 1) END)::INTEGER AS level, list_reduce(list_prepend(0.0, h), lambda s, x: CASE WHEN x >= 0.6 THEN least(s + 1, 4) ELSE 0 END)::INTEGER AS stage, "
       # a state of 5 and more: no attempt before; of 10 and more: weak
       "list_reduce(list_prepend(5.0, h), lambda s, x: x + CASE WHEN s % 10 < 0.6 AND x < 0.6 THEN 10 WHEN x < 0.5 THEN 10 WHEN s % 10 >= 0.8 AND s % 10 < 5 AND x >= 0.8 THEN 0 WHEN s >= 10 THEN 10 ELSE 0 END) >= 10 AS weak, list_max(h) AS best, h[-1] AS last, len(h[-10:])::INTEGER AS n_history, round(list_sum(h[-10:]), 6) AS sum_history FROM a")
def mastery_levels(spark, sf_dir):
    tries = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("value") / 100.0) % 1.0).alias("accuracy"))
    out = rules.mastery(tries, "user_id", "event_id", "accuracy")
    total = F.aggregate("history", F.lit(0.0), lambda s, x: s + x)
    return out.withColumns({"n_history": F.size("history"), "sum_history": F.round(total, 6)}).drop("history")


@query("WITH a AS (SELECT CASE turn % 3 WHEN 0 THEN (lower(trim(role)) = 'user')::INTEGER::DOUBLE WHEN 1 THEN (length(text) % 2)::DOUBLE END AS score, ['kp' || turn % 4, role] AS points FROM conversations), e AS (SELECT score, unnest(points) AS point FROM a WHERE score IS NOT NULL) SELECT point, count(*) AS n, round(avg(score), 6) AS accuracy FROM e GROUP BY 1")
def knowledge_accuracy(spark, sf_dir):
    turn = F.col("turn")
    score = F.when(turn % 3 == 0, (F.lower(F.trim("role")) == "user").cast("double")).when(turn % 3 == 1, (F.length("text") % 2).cast("double"))
    answers = table(spark, sf_dir, "conversations").select(score.alias("score"), F.array(F.concat(F.lit("kp"), (turn % 4).cast("string")), "role").alias("points"))
    return rules.accuracy_by_point(answers, "points", "score").withColumn("accuracy", F.round("accuracy", 6))


@query("WITH r AS (SELECT user_id, DATE '2024-01-01' + (user_id % 20)::INTEGER AS day, (user_id % 5)::INTEGER AS stage, user_id % 3 = 0 AS weak FROM (SELECT DISTINCT user_id FROM events)), n AS (SELECT *, day + [1,2,4,7,15][stage + 1] AS next_day FROM r) SELECT user_id, strftime(next_day, '%Y-%m-%d') AS next_day, next_day <= DATE '2024-01-15' OR (weak AND day >= DATE '2024-01-12') AS due FROM n")
def review_due(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    r = users.select("user_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 20).cast("int")).alias("day"), (F.col("user_id") % 5).cast("int").alias("stage"), (F.col("user_id") % 3 == 0).alias("weak"))
    nxt = rules.next_review(F.col("day"), F.col("stage"))
    return r.select("user_id", F.date_format(nxt, "yyyy-MM-dd").alias("next_day"), rules.review_due(nxt, F.col("weak"), F.col("day"), F.lit("2024-01-15").cast("date")).alias("due"))


_ANSWERS = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'fill_in_blank' WHEN 1 THEN 'choice' ELSE 'short_answer' END AS kind, CASE WHEN conv_id % 2 = 0 THEN ' A ' ELSE 'a' END AS given FROM conversations"


@query(f"WITH a AS ({_ANSWERS}), s AS (SELECT conv_id, CASE kind WHEN 'fill_in_blank' THEN (lower(trim(given)) = 'a')::INTEGER::DOUBLE WHEN 'choice' THEN (trim(given) = 'A')::INTEGER::DOUBLE END AS score FROM a) SELECT conv_id, coalesce(sum(score), 0) AS score, count(score) AS total, count(*) FILTER (score IS NULL) AS needs_review, avg(score) AS accuracy FROM s GROUP BY 1")
def quiz_score(spark, sf_dir):
    turn = F.col("turn") % 3
    a = table(spark, sf_dir, "conversations").select("conv_id", F.when(turn == 0, "fill_in_blank").when(turn == 1, "choice").otherwise("short_answer").alias("kind"), F.when(F.col("conv_id") % 2 == 0, " A ").otherwise("a").alias("given"))
    s = a.withColumn("score", rules.answer_score(F.col("kind"), F.col("given"), F.lit("A")))
    return s.groupBy("conv_id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"), F.count("score").alias("total"), F.count_if(F.col("score").isNull()).alias("needs_review"), F.avg("score").alias("accuracy"))


_SCHOOL = "SELECT o_custkey, o_orderkey, floor(o_totalprice % 100)::INTEGER AS p, o_orderkey % 7 = 0 AS rec FROM orders"
_MAJOR = "SELECT l_orderkey AS o_orderkey, floor(l_extendedprice % 100)::INTEGER AS p, l_discount >= 0.1 AS rec FROM lineitem"


@query(f"WITH s AS ({_SCHOOL}), m AS ({_MAJOR}), j AS (SELECT s.o_custkey, m.p, m.rec FROM s JOIN m USING (o_orderkey)), a AS (SELECT o_custkey, p FROM s UNION ALL SELECT o_custkey, p FROM j), r AS (SELECT o_custkey, min(p) AS low, max(p) AS high FROM a GROUP BY 1), g AS (SELECT o_custkey, count(*) AS n_groups, min(o_orderkey) AS sort_index, bool_or(rec) AS rec FROM s GROUP BY 1), h AS (SELECT o_custkey, bool_or(rec) AS mrec FROM j GROUP BY 1) SELECT o_custkey, n_groups, low, high, CASE WHEN low = high THEN low || '%' ELSE low || '%–' || high || '%' END AS display, CASE WHEN g.rec AND coalesce(mrec, false) THEN 0 WHEN g.rec THEN 1 ELSE 2 END AS rank, sort_index FROM g JOIN r USING (o_custkey) LEFT JOIN h USING (o_custkey) ORDER BY rank, sort_index")
def group_minmax_nested(spark, sf_dir):
    part = lambda c: F.floor(F.col(c) % 100).cast("int")
    schools = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", part("o_totalprice").alias("p"), (F.col("o_orderkey") % 7 == 0).alias("rec"))
    majors = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), part("l_extendedprice").alias("p"), (F.col("l_discount") >= 0.1).alias("rec"))
    return rules.group_schools(schools, majors, "o_custkey", "o_orderkey", "p", "rec")


@query("""WITH e AS (SELECT 'day' AS kind, strftime(ts, '%Y-%m-%d') AS name, user_id FROM events UNION ALL SELECT 'chapter', strftime(ts, '%Y-%m'), user_id FROM events UNION ALL SELECT 'character', unnest([event_type, 'user ' || user_id % 50]), user_id FROM events)
SELECT kind, name, count(*) AS n, count(DISTINCT user_id) AS users FROM e GROUP BY ALL""")
def group_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    people = F.array("event_type", F.concat(F.lit("user "), (F.col("user_id") % 50).cast("string")))
    keys = F.flatten(F.array(F.array(F.struct(F.lit("day").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("name")), F.struct(F.lit("chapter").alias("kind"), F.date_format("ts", "yyyy-MM").alias("name"))), F.transform(people, lambda x: F.struct(F.lit("character").alias("kind"), x.alias("name")))))
    return events.select("user_id", F.inline(keys)).groupBy("kind", "name").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, round(n * 100.0 / (SELECT count(*) FROM documents), 4)::DOUBLE AS share FROM g")
def category_share(spark, sf_dir):
    g = table(spark, sf_dir, DOC).groupBy("source").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("source", "n", F.round(F.col("n") * 100.0 / F.col("t"), 4).alias("share"))  # one row is broadcast


@query("SELECT event_id, '2024' AS year, ((props::JSON->>'k')::BIGINT)::VARCHAR AS score, event_type AS rank FROM events")
def score_history(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('[{"2024":"'), F.get_json_object("props", "$.k"), F.lit(","), "event_type", F.lit('"}]')).alias("j"))
    one = raw.select("event_id", F.explode(F.from_json("j", "array<map<string,string>>")).alias("m")).select("event_id", F.explode("m").alias("year", "triple"))
    return one.select("event_id", "year", F.get(F.split("triple", ","), 0).alias("score"), F.coalesce(F.get(F.split("triple", ","), 1), F.lit("-")).alias("rank"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 3 < 2 THEN 'first' WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'plain' ELSE 'other' END AS batch FROM customer")
def batch_resolution(spark, sf_dir):
    key = F.col("c_custkey") % 3
    given = F.when(key == 1, " plain").when(key == 2, "other")
    out = rules.batch_for(F.col("c_mktsegment"), given, {"BUILDING": "first", "NOWHERE": "x"}, "plain")
    return table(spark, sf_dir, "customer").select("c_custkey", F.trim(out).alias("batch"))


_CELLS = """SELECT 'b' AS book, 'S' || l_returnflag AS sheet, l_orderkey + 1 AS "row", l_linenumber::INTEGER AS col,
 CASE (l_partkey + l_linenumber) % 11 WHEN 0 THEN '=FILTER(A1:A9, XLOOKUP(B2, C:C))' WHEN 1 THEN '=SUM(A1:B' || (l_partkey % 400 + 1) || ')' WHEN 2 THEN '=[other.xlsx]Sheet1!A1' WHEN 3 THEN '=A1/B' || l_suppkey
 WHEN 4 THEN '=just text' WHEN 5 THEN '=MATCH(TRUE, A1:A9>3, 0)' WHEN 6 THEN '=COUNT(A' || l_linenumber || ':A' || (l_partkey % 5 + 1) || ')' WHEN 7 THEN '=SUM(SR!A2:A' || l_partkey * 40 || ')' WHEN 8 THEN '=AVERAGE(B5:C' || l_partkey * 300 || ')' END AS formula,
 CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN '#REF!' WHEN 1 THEN '0' ELSE l_quantity::VARCHAR END AS value FROM lineitem"""


def _cells(spark, sf_dir):
    k, text = (F.col("l_partkey") + F.col("l_linenumber")), lambda c: c.cast("string")
    forms = [
        F.lit("=FILTER(A1:A9, XLOOKUP(B2, C:C))"), F.concat(F.lit("=SUM(A1:B"), text(F.col("l_partkey") % 400 + 1), F.lit(")")), F.lit("=[other.xlsx]Sheet1!A1"), F.concat(F.lit("=A1/B"), text(F.col("l_suppkey"))), F.lit("=just text"), F.lit("=MATCH(TRUE, A1:A9>3, 0)"),
        F.concat(F.lit("=COUNT(A"), text(F.col("l_linenumber")), F.lit(":A"), text(F.col("l_partkey") % 5 + 1), F.lit(")")), F.concat(F.lit("=SUM(SR!A2:A"), text(F.col("l_partkey") * 40), F.lit(")")), F.concat(F.lit("=AVERAGE(B5:C"), text(F.col("l_partkey") * 300), F.lit(")")),
    ]
    formula = F.get(F.array(*forms), (k % 11).cast("int"))
    value = F.when(k % 7 == 0, "#REF!").when(k % 7 == 1, "0").otherwise(text(F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").select(F.lit("b").alias("book"), F.concat(F.lit("S"), "l_returnflag").alias("sheet"), (F.col("l_orderkey") + 1).alias("row"), F.col("l_linenumber").cast("int").alias("col"), formula.alias("formula"), value.alias("value"))


_FORBIDDEN_SQL = " UNION ALL ".join(f"SELECT sheet, \"row\", col, 'forbidden_function' AS finding, '{n}' AS detail FROM c WHERE regexp_matches(upper(formula), '\\b{n}\\s*\\(')" for n in workbook.FORBIDDEN)


@query(rf"""WITH c AS ({_CELLS}) {_FORBIDDEN_SQL} UNION ALL SELECT sheet, "row", col, 'text_as_formula', formula FROM c WHERE formula IS NOT NULL AND NOT regexp_matches(formula, '{workbook.REAL_FORMULA}', 'i')
 UNION ALL SELECT sheet, "row", col, 'external_file_ref', upper(regexp_extract(formula, '\[([^\]]+\.xlsx)\]', 1)) FROM c WHERE regexp_matches(formula, '\[[^\]]+\.xlsx\]')""")
def workbook_validate(spark, sf_dir):
    return workbook.validate(_cells(spark, sf_dir)).select("sheet", "row", "col", "finding", "detail")


@query(f"""WITH c AS ({_CELLS}) SELECT sheet, "row", col, 'error' AS finding FROM c WHERE formula IS NOT NULL AND value = '#REF!' UNION ALL SELECT sheet, "row", col, 'zero' FROM c WHERE formula IS NOT NULL AND try_cast(value AS DOUBLE) = 0 UNION ALL SELECT sheet, "row", col, 'implicit_array' FROM c WHERE starts_with(formula, '=MATCH(TRUE,')""")
def workbook_audit(spark, sf_dir):
    return workbook.audit(_cells(spark, sf_dir)).select("sheet", "row", "col", "finding")


@query(rf"""WITH c AS ({_CELLS}), m AS (SELECT sheet, max("row") AS last FROM c GROUP BY 1),
e AS (SELECT c.sheet, "row", col, formula, CASE WHEN contains(formula, '!A2:') THEN 'SR' ELSE c.sheet END AS target, try_cast(regexp_extract(formula, '[A-Z]+\d+:[A-Z]+(\d+)', 1) AS BIGINT) AS stop, try_cast(regexp_extract(formula, '[A-Z]+(\d+):', 1) AS BIGINT) AS start FROM c WHERE formula IS NOT NULL)
SELECT e.sheet, "row", col, 'out_of_range' AS finding FROM e JOIN m ON m.sheet = target WHERE stop > last * 3 AND stop > 100
UNION ALL SELECT sheet, "row", col, 'header_included' FROM e WHERE regexp_matches(formula, '(SUM|COUNT)\([A-Z]1:') AND "row" > 1
UNION ALL SELECT sheet, "row", col, 'small_aggregate' FROM e WHERE regexp_matches(formula, '=(SUM|COUNT|AVERAGE)\([A-Z]') AND NOT contains(formula, '!') AND abs(stop - start) + 1 <= 2""")
def workbook_scan(spark, sf_dir):
    return workbook.scan(_cells(spark, sf_dir)).select("sheet", "row", "col", "finding")


@query("WITH n AS (SELECT l_suppkey, l_returnflag AS pattern, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, pattern) AS k, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM n) SELECT l_suppkey, pattern, (total - n)::BIGINT AS outliers FROM r WHERE k = 1")
def dominant_pattern(spark, sf_dir):
    return rules.dominant(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query(f"""WITH c AS ({_CELLS}), b AS (SELECT sheet, count(DISTINCT "row") AS data_rows, count(formula) AS n_formulas FROM c WHERE "row" > 1 GROUP BY 1), h AS (SELECT sheet, string_agg(coalesce(formula, value), '|' ORDER BY col) AS headers FROM c WHERE "row" = 1 GROUP BY 1), s AS (SELECT sheet, max("row") AS n_rows, max(col) AS n_columns FROM c GROUP BY 1)
SELECT s.sheet, 'A1:' || chr(64 + n_columns) || n_rows AS data_range, n_rows, n_columns, data_rows, n_formulas, coalesce(headers, '') AS headers FROM s LEFT JOIN b USING (sheet) LEFT JOIN h USING (sheet)""")
def sheet_inspect(spark, sf_dir):
    return workbook.inspect(_cells(spark, sf_dir)).drop("book").withColumn("headers", F.array_join("headers", "|"))


@query("SELECT p_partkey, (p_partkey % 26 + 1 + 26)::INTEGER AS col, (p_partkey % 1000)::INTEGER AS row FROM part".replace(" AS row", ' AS "row"'))
def a1_range(spark, sf_dir):
    ref = F.concat(F.lit("$A"), F.char(F.col("p_partkey") % 26 + 65), F.lit("$"), (F.col("p_partkey") % 1000).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.a1_column(ref).alias("col"), rules.a1_row(ref).alias("row"))


def _story(text):
    """Whole documents, in which each sentence end is followed by a chapter or a date."""
    return F.replace(F.replace(text, F.lit(". "), F.lit(". CHAPTER  7 ")), F.lit(", "), F.lit(" **Date:** May 5\n"))


_STORY = r"replace(replace(text, '. ', '. CHAPTER  7 '), ', ', ' **Date:** May 5' || chr(10))"
_PLACES = """WITH t AS (SELECT doc_id, {0} AS t FROM documents), p AS (SELECT doc_id, unnest(string_split(t, '{1}')) AS part, generate_subscripts(string_split(t, '{1}'), 1) AS i, len(string_split(t, '{1}')) AS n FROM t),
q AS (SELECT doc_id, i, n, sum(length(part) + {2}) OVER (PARTITION BY doc_id ORDER BY i) - {2} AS pos FROM p) SELECT doc_id, pos::INTEGER AS pos, {3} AS kind, '{4}' AS marker FROM q WHERE i < n"""


@query("SELECT * FROM (" + _PLACES.format(_STORY, "CHAPTER  7", 10, 3, "7") + ") UNION ALL SELECT * FROM (" + _PLACES.format(_STORY, "**Date:** May 5", 15, 5, "May 5") + ")")
def timeline_markers(spark, sf_dir):
    return stories.markers(table(spark, sf_dir, DOC).select("doc_id", _story(F.col("text")).alias("t")), "doc_id", "t")


@query("WITH t AS (SELECT doc_id, replace(text, '. ', '. CHAPTER  7 ') AS t FROM documents), p AS (SELECT doc_id, t, unnest(string_split(t, 'CHAPTER  7')) AS part, generate_subscripts(string_split(t, 'CHAPTER  7'), 1) AS i, len(string_split(t, 'CHAPTER  7')) AS n FROM t) SELECT doc_id, greatest(i - 1, 1)::INTEGER AS no, doc_id::VARCHAR AS chapter, CASE WHEN n > 1 THEN '7' END AS timepoint, (length(part) + CASE WHEN n > 1 THEN 10 ELSE 0 END)::INTEGER AS length, left(CASE WHEN n > 1 THEN 'CHAPTER  7' ELSE '' END || part, 500) AS preview FROM p WHERE i > 1 OR n = 1")
def story_sections(spark, sf_dir):
    rows = table(spark, sf_dir, DOC).select("doc_id", F.replace("text", F.lit(". "), F.lit(". CHAPTER  7 ")).alias("t"))
    return stories.sections(rows, "doc_id", "t").drop("start")


_PROFILE = "SELECT n_nationkey, '# ' || n_name || chr(10) || '**Age:** ' || (n_nationkey + 20) || chr(10) || 'Hair: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'black' ELSE 'red' END || ', long' || chr(10) || '**Aliases:** A' || n_nationkey || '; ' || left(n_name, 2) AS profile FROM nation"


@query(f"WITH p AS ({_PROFILE}) SELECT n_name AS name, (n_nationkey + 20)::VARCHAR AS age, CASE WHEN n_nationkey % 2 = 0 THEN 'black' ELSE 'red' END AS hair, 'A' || n_nationkey || ',' || left(n_name, 2) AS aliases FROM nation JOIN p USING (n_nationkey)")
def character_profiles(spark, sf_dir):
    return stories.profiles(_profile_texts(spark, sf_dir), F.col("profile")).select("name", "age", "hair", F.array_join("aliases", ",").alias("aliases"))


def _profile_texts(spark, sf_dir):
    key = F.col("n_nationkey")
    text = F.concat(F.lit("# "), "n_name", F.lit("\n**Age:** "), (key + 20).cast("string"), F.lit("\nHair: "), F.when(key % 2 == 0, "black").otherwise("red"), F.lit(", long\n**Aliases:** A"), key.cast("string"), F.lit("; "), F.substring("n_name", 1, 2))
    return table(spark, sf_dir, "nation").select(text.alias("profile"))


@query("""WITH c AS (SELECT c_custkey, n_name, n_nationkey, c_custkey % 60 AS told FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, n_name AS name, 'age' AS issue, told::VARCHAR AS detail FROM c WHERE told <> n_nationkey + 20 UNION ALL SELECT c_custkey, n_name, 'hair', n_name || ' had red hair once' FROM c WHERE n_nationkey % 2 = 0 UNION ALL SELECT c_custkey, n_name, 'capitals', lower(n_name) FROM c WHERE c_custkey % 3 = 0""")
def story_issues(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat("n_name", F.lit(" is a "), (F.col("c_custkey") % 60).cast("string"), F.lit(" year old. "), "n_name", F.lit(" had red hair once. "), F.when(F.col("c_custkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return stories.issues(c.select("c_custkey", text.alias("t")), "c_custkey", "t", stories.profiles(_profile_texts(spark, sf_dir), F.col("profile")))


@query(r"WITH t AS (SELECT doc_id, '{\rtf1\b ' || replace(text, chr(10), '\par ') || '}' AS rtf FROM documents) SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(rtf, '\par', chr(10)), '\\[a-zA-Z]+-?\d+ ?', '', 'g'), '\\[a-zA-Z]+ ?', '', 'g'), '[{}]', '', 'g'), ' ') AS plain FROM t")
def rtf_text(spark, sf_dir):
    from foliant.sources.extract import rtf_plain

    rtf = F.concat(F.lit(r"{\rtf1\b "), F.replace("text", F.lit("\n"), F.lit(r"\par ")), F.lit("}"))
    return table(spark, sf_dir, DOC).select("doc_id", rtf_plain(rtf).alias("plain"))


_POSTING = "text || CASE conv_id % 5 WHEN 0 THEN ' 本科及以上, 3-5 年, 上海 or Remote, 英语流利' WHEN 1 THEN ' 硕士 3年以上 CPA CFA Level 2 CPA' WHEN 2 THEN ' 出差 CET-6 北京' ELSE '' END"


@query(rf"""WITH p AS (SELECT conv_id, turn, {_POSTING} AS p FROM conversations) SELECT conv_id, turn, regexp_extract(p, '((?:本科|硕士|博士|大专)(?:及以上|以上)?)', 1) AS education, regexp_extract(p, '(\d+\s*[-~–到至]\s*\d+\s*年|\d+\s*\+?\s*年(?:以上|及以上)?)', 1) AS years,
 regexp_extract(p, '(英语\s*(?:口语)?\s*(?:流利|熟练|母语)|CET[-\s]?[46]|雅思\s*\d(?:\.\d)?|托福\s*\d{{2,3}}|母语水平|business\s*english)', 1, 'i') AS language, regexp_extract(p, '(出差|派驻|常驻|项目制|加班|999|996|大小周)', 1) AS working_style,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(p, '(?i)(北京|上海|广州|深圳|杭州|南京|苏州|成都|武汉|西安|香港|新加坡|remote|hybrid|远程|海外)'), lambda x: lower(x)))), '/') AS location,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(p, '(?i)(CFA(?:\s*Level\s*[I123]+)?|CPA|FRM|ACCA|PMP|AWS\s*[0-9A-Za-z_\s]*认证|Azure\s*[0-9A-Za-z_]*|GCP\s*[0-9A-Za-z_]*)'), lambda x: trim(x)))), '/') AS certificates FROM p""")
def special_requirements(spark, sf_dir):
    k = F.col("conv_id") % 5
    posting = F.concat("text", F.when(k == 0, " 本科及以上, 3-5 年, 上海 or Remote, 英语流利").when(k == 1, " 硕士 3年以上 CPA CFA Level 2 CPA").when(k == 2, " 出差 CET-6 北京").otherwise(""))
    found = rules.special_requirements(posting)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in found.items()])


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'q_unknown' ELSE 'q' || turn END AS id, CASE WHEN turn % 2 = 0 THEN 'choice' ELSE 'single_choice' END AS type, 1 AS level, text AS prompt, role AS answer, 0 AS n_options FROM conversations")
def quiz_json(spark, sf_dir):
    turn = F.col("turn")
    item = F.struct(F.when(turn % 3 != 0, F.concat(F.lit("q"), turn.cast("string"))).alias("id"), F.when(turn % 2 == 0, "choice").alias("type"), F.col("text").alias("prompt"), F.col("role").alias("answer"))
    raw = F.concat(F.when(turn % 4 < 2, "```json\n").otherwise(""), F.to_json(F.array(item)), F.when(turn % 4 < 2, "\n```").otherwise(""))
    one = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(rules.questions(raw)).alias("q"))
    return one.select("conv_id", "turn", "q.id", "q.type", "q.level", "q.prompt", "q.answer", F.size("q.options").alias("n_options"))


_KEYS = ["pathetic", "Moronity", "zzzzqq"]


@query("""WITH k AS (SELECT doc_id, text, unnest(['pathetic', 'Moronity', 'zzzzqq']) AS keyword FROM documents), h AS (SELECT *, instr(lower(text), lower(keyword))::INTEGER AS hit FROM k), b AS (SELECT *, greatest(1, hit - 30) AS b FROM h)
SELECT doc_id, keyword, CASE WHEN hit > 0 THEN 'perfect' WHEN contains(lower(text), lower(left(keyword, 4))) THEN 'implicit' ELSE 'missing' END AS kind, CASE WHEN hit > 0 THEN trim(replace(substring(text, b, hit + length(keyword) + 30 - b), chr(10), ' ')) WHEN contains(lower(text), lower(left(keyword, 4))) THEN lower(left(keyword, 4)) END AS detail FROM b""")
def keyword_gaps(spark, sf_dir):
    return rules.gaps(table(spark, sf_dir, DOC), "doc_id", "text", _KEYS)


@query()
def skills_extract(spark, sf_dir):
    return rules.skills(table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("key"), "text"), "key", "text")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'path') THEN 'path' END AS part, array_to_string(CASE WHEN contains(lower(text), 'owner') OR contains(lower(text), 'drive') OR contains(lower(text), 'lead') OR contains(lower(text), '0-1') THEN ['ownership'] ELSE ['ownership'] END, ',') AS kinds FROM documents")
def fuzzy_and_kinds(spark, sf_dir):
    return table(spark, sf_dir, DOC).select("doc_id", rules.fuzzy_part(F.col("text"), "Pathology").alias("part"), F.array_join(rules.story_kinds(F.col("text")), ",").alias("kinds"))
