"""Rule-based scores, classifications and extractions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.fts import Bm25

#: Keywords by domain, in order of precedence.
DOMAINS = {
    "color": ["color", "palette", "hex", "#", "rgb"],
    "chart": ["chart", "graph", "visualization", "trend", "bar", "pie", "scatter", "heatmap", "funnel"],
    "landing": ["landing", "page", "cta", "conversion", "hero", "testimonial", "pricing", "section"],
    "product": ["saas", "ecommerce", "e-commerce", "fintech", "healthcare", "gaming", "portfolio", "crypto", "dashboard"],
    "style": ["style", "design", "ui", "minimalism", "glassmorphism", "neumorphism", "brutalism", "dark mode", "flat", "aurora", "prompt", "css", "implementation", "variable", "checklist", "tailwind"],
    "ux": ["ux", "usability", "accessibility", "wcag", "touch", "scroll", "animation", "keyboard", "navigation", "mobile"],
    "typography": ["font", "typography", "heading", "serif", "sans"],
    "icons": ["icon", "icons", "lucide", "heroicons", "symbol", "glyph", "pictogram", "svg icon"],
    "react": ["react", "next.js", "nextjs", "suspense", "memo", "usecallback", "useeffect", "rerender", "bundle", "waterfall", "barrel", "dynamic import", "rsc", "server component"],
    "web": ["aria", "focus", "outline", "semantic", "virtualize", "autocomplete", "form", "input type", "preconnect"],
}
#: Requirement phrases.
NICE = [r"加分", r"优先", r"加分项", r"熟悉.+者优先", r"有.+经验者优先", r"preferred", r"nice\s*to\s*have", r"plus", r"bonus", r"desirable"]
MUST = [r"必须", r"必备", r"必要条件", r"硬性要求", r"应当", r"需要", r"需具备", r"至少\s*\d+\s*年", r"\d+\+?\s*年以上", r"required", r"must\s*have", r"mandatory", r"essential", r"minimum\s+\d+\s+years"]
VERBS = ["负责", "主导", "推动", "设计", "搭建", "构建", "优化", "规划", "迭代", "孵化", "复盘", "运营", "管理", "协调", "执行", "驱动", "落地", "重构", "lead", "drive", "build", "design", "architect", "develop", "implement", "optimize", "manage", "coordinate", "execute", "own"]
#: Points of rumor kinds, and review intervals in days.
RUMORS = {"ma": 5, "insider": 4, "analyst": 3, "regulatory": 3, "earnings": 2}
INTERVALS = [1, 2, 4, 7, 15]


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def domain_of(query: Column, domains: dict[str, list[str]] = DOMAINS, default: str = "style") -> Column:
    """The domain with most keywords in the query; the first of equals; without any the default."""
    low = F.lower(query)
    table = F.array(*[F.struct(F.lit(-k).alias("rank"), F.lit(name).alias("name"), F.array(*[F.lit(w) for w in words]).alias("words")) for k, (name, words) in enumerate(domains.items())])
    best = F.array_max(F.transform(table, lambda d: F.struct(F.size(F.filter(d["words"], lambda w: F.contains(low, w))).alias("n"), d["rank"].alias("rank"), d["name"].alias("name"))))
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(default))


_WORD = r"[\p{L}\p{N}_]"


def plain_count(text: Column) -> Column:
    """How many lower-cased words of over two characters a text has."""
    return F.regexp_count(F.lower(text), F.lit(_WORD + "{3,}"))


def plain_tf(text: Column, word: str) -> Column:
    """How often a lower-cased word of over two characters is a whole word of a text."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<!{_WORD})\Q{word}\E(?!{_WORD})"))


def bm25_plain(rows: DataFrame, key: str, text: str, asked: list[str], k: int = 10) -> DataFrame:
    """Top k rows by the positive BM25 variant; a repeated query word counts again; rows scoring zero go afterwards.

    Texts are scanned once: their counts, a few numbers a row, are shuffled, and both the statistics and the scores read that.
    """
    variant = Bm25(k1=1.5, b=0.75, floor=None, plus_one=True, sign=1)
    unique = list(dict.fromkeys(asked))
    tf = rows.select(key, plain_count(F.col(text)).cast("double").alias("dl"), *[plain_tf(F.col(text), t).alias(f"tf{i}") for i, t in enumerate(unique)]).repartition(key)
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(unique))])
    parts = [asked.count(t) * F.when(F.col(f"tf{i}") > 0, variant.part(F.col(f"tf{i}"), variant.idf(F.col(f"n{i}"), F.col("n")), F.col("dl"), F.col("avgdl"))).otherwise(F.lit(0.0)) for i, t in enumerate(unique)]
    scored = tf.crossJoin(F.broadcast(stats)).select(key, reduce(lambda a, b: a + b, parts).alias("score"))  # one row is broadcast
    return scored.orderBy(F.desc("score"), key).limit(k).where("score > 0")


def best_match_points(name: Column, keywords: Column, everything: Column, priorities: list[str]) -> Column:
    """10 for a keyword in the name, else 3 in the keywords, else 1 anywhere."""
    parts = []
    for p in (x.lower().strip() for x in priorities):
        parts.append(F.when(F.contains(F.lower(name), F.lit(p)), 10).when(F.contains(F.lower(keywords), F.lit(p)), 3).when(F.contains(F.lower(everything), F.lit(p)), 1).otherwise(0))
    return reduce(lambda a, b: a + b, parts)


def payout_status(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio < 40, "safe").when(ratio < 60, "moderate").when(ratio < 80, "high").otherwise("unsustainable")


def safety_score(payout: Column, growth: Column, years: Column, dividend_yield: Column) -> Column:
    """50 and bands of payout, growth, years and yield, within 0 and 100; nulls add nothing."""
    a = F.when(payout.isNull(), 0).when(payout < 40, 20).when(payout < 60, 10).when(payout < 80, -10).otherwise(-20)
    b = F.when(growth.isNull(), 0).when(growth > 10, 15).when(growth > 5, 10).when(growth > 0, 5).otherwise(-15)
    c = F.when(years >= 25, 15).when(years >= 10, 10).when(years >= 5, 5).otherwise(0)
    d = F.when(dividend_yield > 8, -10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 50 + a + b + c + d))


def income_rating(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "moderate").otherwise("poor")


def impact_score(kind: Column, text: Column, engaged: Column) -> Column:
    base = reduce(lambda a, kv: a.when(kind == kv[0], kv[1]), list(RUMORS.items())[1:], F.when(kind == "ma", RUMORS["ma"])).otherwise(1)
    urgent = F.when(F.lower(text).rlike("breaking|just in|alert|urgent"), 2).otherwise(0)
    return F.least(F.lit(10), 1 + base + urgent + F.when(engaged, 2).otherwise(0))


def market_of(code: Column) -> Column:
    return F.when(code.rlike(r"^\d{6}$"), "CN").when(F.upper(code).rlike(r"^\d{4,5}\.HK$"), "HK").otherwise("US")


def quote_warnings(price: Column, ma5: Column, ma20: Column, overbought: Column, roe: Column, pe: Column) -> Column:
    """Names of what a quote lacks."""
    none = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    return F.array_compact(F.array(F.when(none(price), "price"), F.when(none(ma5) & none(ma20), "technical"), F.when(overbought, "overbought"), F.when(none(roe) & none(pe), "fundamental")))


def watch_deltas(price: Column, added: Column, target: Column, stop: Column) -> dict[str, Column]:
    """Percent changes since adding, to the target and to the stop, rounded to 2; null where a price is missing or 0."""
    share = lambda a, b: F.round((a - b) / F.nullif(b, F.lit(0.0)) * 100, 2)
    return {"change_pct": share(F.nullif(price, F.lit(0.0)), added), "to_target_pct": share(F.nullif(target, F.lit(0.0)), price), "to_stop_pct": share(F.nullif(stop, F.lit(0.0)), price)}


def alerts(price: Column, target: Column, stop: Column, last: Column, signal: Column) -> Column:
    """array<string>: target_hit, stop_hit, signal_change."""
    return F.array_compact(F.array(F.when(price >= target, "target_hit"), F.when(price <= stop, "stop_hit"), F.when(last.isNotNull() & (signal != last), "signal_change")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[。！？!?；;\n]+"), lambda s: F.regexp_replace(s, r"^[ \t\-•·*]+|[ \t\-•·*]+$", "")), lambda s: s != "")


def sentence_kind(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.rlike("|".join(NICE)), "nice").when(low.rlike("|".join(MUST)), "must").when(any_of(low, VERBS), "responsibilities").otherwise("others")


def ats_score(text: Column) -> Column:
    """10 less what makes a text hard to read for machines: length, contacts, symbols, emoji, few numbers."""
    bullets = F.regexp_count(text, F.lit(r"(?m)^\s*[-*•]\s+"))
    numbers = F.regexp_count(text, F.lit(r"\d+(?:\.\d+)?%?"))
    minus = [
        F.when(F.length(text) < 200, 3).when(F.length(text) > 6000, 1).otherwise(0),
        F.when(text.rlike(r"[\w.\-+]+@[\w.\-]+\.\w+"), 0).otherwise(1),
        F.when(text.rlike(r"(\+?86[-\s]?)?1[3-9]\d{9}|\d{3}[-\s]?\d{4}[-\s]?\d{4}"), 0).otherwise(1),
        F.when(F.regexp_count(text, F.lit("[★☆●○◆◇▶▷■□▪▫♦]")) > 5, 1).otherwise(0),
        F.when(text.rlike(r"[\x{1F300}-\x{1FAFF}]"), 1).otherwise(0),
        F.when((bullets > 0) & (numbers / F.nullif(bullets.cast("double"), F.lit(0.0)) < 0.4), 1).otherwise(0),
    ]
    return F.greatest(F.lit(0), 10 - reduce(lambda a, b: a + b, minus))


def evidence(text: Column, keyword: str, around: int = 30) -> Column:
    """The text around the first match in any case, on one line; null without a match."""
    at = F.instr(F.lower(text), keyword.lower())
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.trim(F.replace(F.substring(text, start, at + len(keyword) + around - start), F.lit("\n"), F.lit(" "))))


def segments(rows: DataFrame, key: str, text: str, anchor: str) -> DataFrame:
    """(key, no, title, n_bullets): lines from each anchor line to the next, where bullets follow it."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    is_anchor = F.col("line").rlike(anchor)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("no", F.sum(is_anchor.cast("int")).over(w)).where("no > 0")
    bullet = ~is_anchor & F.col("line").rlike(r"^[-*•]")
    return numbered.groupBy(key, "no").agg(F.min_by("line", "pos").alias("title"), F.count_if(bullet).alias("n_bullets")).where("n_bullets > 0")


def answer_score(kind: Column, given: Column, right: Column) -> Column:
    """1 or 0 for blanks (any case) and choices (exact); null where a person has to judge."""
    return F.when(kind == "fill_in_blank", (F.lower(F.trim(given)) == F.lower(F.trim(right))).cast("double")).when(kind == "choice", (F.trim(given) == F.trim(right)).cast("double"))


HISTORY = 10


def mastery(attempts: DataFrame, key: str, order: str, accuracy: str) -> DataFrame:
    """Level, review stage, weakness, best and last accuracies and the last HISTORY ones after a key's attempts in order.

    Levels walk within 1..3 from 1, so two equal outcomes in a row fix the level (3 or 1), and after the last such pair
    outcomes alternate; the stage is the run of right answers at the end, at most 4. Windows need no list of a key's attempts.
    """
    own = attempts.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(accuracy).cast("double").alias("a"))
    w = Window.partitionBy("key").orderBy("order")
    seen = own.withColumns({"p": F.lag("a").over(w), "i": F.row_number().over(w), "back": F.row_number().over(Window.partitionBy("key").orderBy(F.desc("order")))})
    right, same = F.col("a") >= 0.6, (F.col("a") >= 0.6) == (F.col("p") >= 0.6)
    turn = F.when((F.col("p") < 0.6) & (F.col("a") < 0.6), True).when(F.col("a") < 0.5, True).when((F.col("p") >= 0.8) & (F.col("a") >= 0.8), False)
    marked = seen.withColumns({"r": right, "turn": turn, "pair": F.when(same, right)})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("i")))
    tail = F.collect_list(F.when(F.col("back") <= HISTORY, F.struct("i", "a")))  # at most HISTORY of a key
    one = marked.groupBy("key").agg(
        F.count("*").cast("int").alias("attempts"), F.max("a").alias("best"), F.max_by("a", "i").alias("last"), F.max_by("r", "i").alias("ok"), F.coalesce(F.max(F.when(~F.col("r"), F.col("i"))), F.lit(0)).alias("wrong"),
        last("turn").alias("weak"), last("pair").alias("high"), F.max("i").alias("n"), F.transform(F.sort_array(tail), lambda x: x["a"]).alias("history"),
    )
    level = F.when(F.col("high").isNull() | ~F.col("high"), F.when(F.col("ok"), 2).otherwise(1)).otherwise(F.when(F.col("ok"), 3).otherwise(2))
    stage = F.least(F.col("n") - F.col("wrong"), F.lit(len(INTERVALS) - 1))
    return one.select(F.col("key").alias(key), "attempts", level.alias("level"), stage.alias("stage"), F.coalesce("weak", F.lit(False)).alias("weak"), "best", "last", "history")


def accuracy_by_point(answers: DataFrame, points: str, score: str) -> DataFrame:
    """(point, n, accuracy) over answers with an array of knowledge points; answers without a score don't count."""
    one = answers.where(F.col(score).isNotNull()).select(F.explode(points).alias("point"), score)
    return one.groupBy("point").agg(F.count("*").alias("n"), F.avg(score).alias("accuracy"))


def next_review(last_reviewed: Column, stage: Column) -> Column:
    return F.date_add(last_reviewed, F.element_at(F.array(*[F.lit(d) for d in INTERVALS]), stage + 1))


def review_due(next_day: Column, weak: Column, last_reviewed: Column, today: Column) -> Column:
    return (next_day <= today) | (weak & (last_reviewed >= F.date_sub(today, 3)))


def coverage(text: Column, words: list[str]) -> Column:
    return hits(F.lower(text), [w.lower() for w in words]) / F.lit(float(max(1, len(words))))


def a1_column(ref: Column) -> Column:
    """The number of a cell reference's column: A is 1, AA is 27."""
    letters = F.split(F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64)


def a1_row(ref: Column) -> Column:
    return F.regexp_extract(ref, r"(\d+)$", 1).try_cast("int")


def batch_for(province: Column, batch: Column, known: dict[str, str], plain: str) -> Column:
    """The batch name that a province uses, where none or the plain one is given."""
    mapped = reduce(lambda a, kv: a.when(province == kv[0], kv[1]), list(known.items())[1:], F.when(province == next(iter(known)), known[next(iter(known))]))
    return F.when(mapped.isNotNull() & (batch.isNull() | (F.trim(batch) == plain)), mapped).otherwise(batch)


def dominant(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """The commonest pattern of each key, the least of equals, and how many rows differ from it."""
    counts = rows.groupBy(key, pattern).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min_by(F.struct(F.col(pattern).alias("p"), F.col("n").alias("m")), F.struct(-F.col("n"), F.col(pattern))).alias("b"), F.sum("n").alias("t"))
    return best.select(key, F.col("b.p").alias("pattern"), (F.col("t") - F.col("b.m")).alias("outliers"))


def special_requirements(text: Column) -> dict[str, Column]:
    """Education, years, language, places, working style and certificates that a posting names; empty without."""
    #: Patterns.
    first = {
        "education": r"((?:本科|硕士|博士|大专)(?:及以上|以上)?)",
        "years": r"(\d+\s*[-~–到至]\s*\d+\s*年|\d+\s*\+?\s*年(?:以上|及以上)?)",
        "language": r"(?i)(英语\s*(?:口语)?\s*(?:流利|熟练|母语)|CET[-\s]?[46]|雅思\s*\d(?:\.\d)?|托福\s*\d{2,3}|母语水平|business\s*english)",
        "working_style": r"(出差|派驻|常驻|项目制|加班|999|996|大小周)",
    }
    every = {
        "location": r"(?i)(北京|上海|广州|深圳|杭州|南京|苏州|成都|武汉|西安|香港|新加坡|remote|hybrid|远程|海外)",
        "certificates": r"(?i)(CFA(?:\s*Level\s*[I123]+)?|CPA|FRM|ACCA|PMP|AWS\s*[\w\s]*认证|Azure\s*\w*|GCP\s*\w*)",
    }
    out = {k: F.regexp_extract(text, p, 1) for k, p in first.items()}
    for k, p in every.items():
        found = F.regexp_extract_all(text, F.lit(p), F.lit(1))
        clean = F.transform(found, (lambda x: F.lower(x)) if k == "location" else (lambda x: F.trim(x)))
        out[k] = F.array_join(F.sort_array(F.array_distinct(clean)), "/")
    return out


QUESTIONS = "array<struct<id:string,knowledge_point_ids:array<string>,level:int,type:string,prompt:string,options:array<string>,answer:string,explanation:string,source_refs:array<string>>>"


def questions(raw: Column) -> Column:
    """Questions from JSON text that may stand in a code fence, absent fields by their defaults; null if it is no list."""
    text = F.trim(raw)
    inside = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    none = F.array().cast("array<string>")
    plain = {"id": F.lit("q_unknown"), "knowledge_point_ids": none, "level": F.lit(1), "type": F.lit("single_choice"), "prompt": F.lit(""), "options": none, "answer": None, "explanation": F.lit(""), "source_refs": none}
    whole = lambda q: F.struct(*[(q[k] if d is None else F.coalesce(q[k], d)).alias(k) for k, d in plain.items()])
    return F.transform(F.from_json(F.when(F.startswith(text, F.lit("```")), inside).otherwise(text), QUESTIONS), whole)


#: Words that are no skills.
NO_SKILLS = (
    "公司 我们 你将 团队 需要 能够 具备 熟悉 了解 良好 优秀 经验 能力 岗位 职责 要求 以上 相关 进行 完成 负责 推动 实现 提升 并且 包括 以下 工作 项目 业务 及其 或者 或 与 及 的 了 "
    "并 对 在 等 以 等等 通过 将 其 之 至 至上 本科 硕士 博士 者优先 根据 进行 支持 参与 主导 提供 建立 搭建 设计 驱动 决策 分析 推动 迭代 规划 运营 协作 跨部门 跨团队 高级 资深 若干 多种 多元 多类 "
    "and the with for of or to be as an is are in on at by all you we us our your a an this that these those it its"
).split()
_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def skills(rows: DataFrame, key: str, text: str, most: int = 60) -> DataFrame:
    """(key, no, skill): the first ``most`` candidate words of each text, Latin ones first, once in any case."""
    latin = F.regexp_extract_all(F.col(text), F.lit(rf"{_EDGE}[A-Za-z][A-Za-z0-9+/.\-_#]{{1,20}}{_EDGE}"), F.lit(0))
    chinese = F.regexp_extract_all(F.col(text), F.lit("[一-龥]{2,5}"), F.lit(0))
    one = rows.select(key, F.posexplode(F.concat(latin, chinese)).alias("pos", "skill")).where(~F.col("skill").isin(NO_SKILLS) & (F.length("skill") > 1))
    first = one.groupBy(key, F.lower("skill").alias("_low")).agg(F.min_by("skill", "pos").alias("skill"), F.min("pos").alias("pos"))
    order = Window.partitionBy(key).orderBy("pos")
    return first.withColumn("no", F.row_number().over(order)).where(F.col("no") <= most).select(key, "no", "skill")


def gaps(texts: DataFrame, key: str, text: str, keywords: list[str]) -> DataFrame:
    """(key, keyword, kind, detail): perfect with the text around, implicit with the part found, or missing."""
    each = []
    for word in dict.fromkeys(k.strip() for k in keywords):
        near, part = evidence(F.col(text), word), fuzzy_part(F.col(text), word)
        each.append(F.struct(F.lit(word).alias("keyword"), F.when(near.isNotNull(), "perfect").when(part.isNotNull(), "implicit").otherwise("missing").alias("kind"), F.coalesce(near, part).alias("detail")))
    return texts.select(key, F.inline(F.array(*each)))


def fuzzy_part(text: Column, keyword: str) -> Column:
    """The part of a keyword that the text has: the first or last two Chinese characters, else the first four letters."""
    if len(keyword) < 4:
        return F.lit(None).cast("string")
    parts = [keyword[:2], keyword[-2:]] if any("一" <= c <= "龥" for c in keyword) else [keyword[:4].lower()]
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(p)), p) for p in parts])


def story_kinds(text: Column) -> Column:
    """array<string>: the kinds of question that an experience answers; ownership if none."""
    #: Words by kind.
    kinds = {
        "ownership": ["主导", "owner", "推动", "drive", "lead", "0-1"],
        "collab": ["跨部门", "跨团队", "协作", "对接", "合作"],
        "challenge": ["紧急", "时间紧", "资源", "决策", "突破"],
        "failure": ["失败", "下线", "回滚", "复盘", "教训", "踩坑"],
        "learning": ["新", "学习", "陌生", "首次", "从零"],
    }
    found = F.array_compact(F.array(*[F.when(any_of(F.lower(text), words), kind) for kind, words in kinds.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ownership")))


def undefined(rows: DataFrame, defined: DataFrame, name: str) -> DataFrame:
    """Names that rows mention and ``defined`` lacks, each once; null is no name."""
    return rows.select(name).where(F.col(name).isNotNull()).distinct().join(defined.select(name).distinct(), name, "left_anti")


def lookup_recs(rows: DataFrame, maps: dict[str, tuple[list[str], DataFrame]]) -> DataFrame:
    """rows with a column for each map, from (keys, table of keys and ``rec``); rows that a map lacks get null."""
    for name, (keys, table) in maps.items():
        rows = rows.join(table.select(*keys, F.col("rec").alias(name)), keys, "left")
    return rows


def match_rules(rows: DataFrame, key: str, exact: str, more: str, known: DataFrame, most: int = 1000) -> DataFrame:
    """(key, rule, stage): the first stage in which a rule fits, and of its rules the first in order of text.

    Stage 1: equal to ``exact``; 2: contained in it; 3: its first three letters are in ``more``. Rules (rule) go into the
    expression, so more than ``most`` are an error.
    """
    names = sorted(r["rule"] for r in known.select("rule").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} rules")
    found = []
    for no, rule in enumerate(names):
        stage = F.when(F.col(exact) == rule, 1).when(F.contains(F.col(exact), F.lit(rule)), 2).when(F.contains(F.col(more), F.lit(rule[:3])), 3)
        found.append(F.when(stage.isNotNull(), F.struct(stage.alias("stage"), F.lit(no).alias("no"), F.lit(rule).alias("rule"))))
    best = rows.select(key, F.array_min(F.array_compact(F.array(*found))).alias("b")).where("b is not null")
    return best.select(key, "b.rule", "b.stage")


def group_schools(schools: DataFrame, majors: DataFrame, group: str, key: str, share: str, rec: str) -> DataFrame:
    """(group, n_groups, low, high, display, rank, sort_index) by rank and index: the range of the shares of a group's
    schools and of their majors; rank 0 with a recommended school and major, 1 with a school alone, else 2."""
    below = majors.join(schools.select(group, key), key).groupBy(group).agg(F.min(share).alias("l"), F.max(share).alias("h"), F.bool_or(rec).alias("m"))
    own = schools.groupBy(group).agg(F.count("*").alias("n_groups"), F.min(key).alias("sort_index"), F.min(share).alias("low"), F.max(share).alias("high"), F.bool_or(rec).alias("s"))
    both = own.join(below, group, "left").withColumns({"low": F.least("low", "l"), "high": F.greatest("high", "h")})
    text = lambda c: F.concat(F.col(c).cast("string"), F.lit("%"))
    rank = F.when(F.col("s") & F.coalesce("m", F.lit(False)), 0).when(F.col("s"), 1).otherwise(2)
    out = both.select(group, "n_groups", "low", "high", F.when(F.col("low") == F.col("high"), text("low")).otherwise(F.concat(text("low"), F.lit("–"), text("high"))).alias("display"), rank.alias("rank"), "sort_index")
    return out.orderBy("rank", "sort_index")
