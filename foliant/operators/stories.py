"""Time markers, sections and character profiles of stories, and what contradicts the profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of time markers, of a profile's attributes, and colours.
MARKERS = [
    r"(?:Day|Night)\s+(\d+)",
    r"(\d+)\s+(?:days?|weeks?|months?|years?)\s+(?:later|ago|after|before)",
    r"(?:Morning|Afternoon|Evening|Night)\s+of\s+(?:Day\s+)?(\d+)",
    r"Chapter\s+(\d+)",
    r"\*\*(?:Timeline|Time|When):\*\*\s*(.+?)(?:\n|$)",
    r"\*\*Date:\*\*\s*(.+?)(?:\n|$)",
]
ATTRIBUTES = {
    "age": r"\*\*Age:\*\*\s*(.+?)(?:\n|$)",
    "appearance": r"\*\*Appearance:\*\*\s*(.+?)(?:\n|$)",
    "hair": r"(?:hair|Hair)[\s:]+([^,\n]+)",
    "eyes": r"(?:eyes|Eyes)[\s:]+([^,\n]+)",
    "height": r"\*\*Height:\*\*\s*(.+?)(?:\n|$)",
    "role": r"\*\*Role:\*\*\s*(.+?)(?:\n|$)",
}
ALIASES = r"\*\*(?:Nicknames?|Aliases?):\*\*\s*(.+?)(?:\n|$)"
COLOURS = "black|brown|blonde|red|auburn|white|gray|grey|blue|green|hazel"
TITLE = r"(?m)^#\s+(.+?)$"
PREVIEW = 500


def places(text: Column, pattern: str, group: int = 1) -> Column:
    """array<struct<pos, marker>>: every match's place (from 0) and trimmed group."""
    p = "(?i)" + pattern
    between = F.transform(F.split(text, p, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.length)
    found = F.regexp_extract_all(text, F.lit(p), F.lit(group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda b, w: F.struct(b.alias("b"), w.alias("w")))
    ends = F.aggregate(steps, start, lambda s, x: F.struct((s["at"] + x["b"] + x["w"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["b"])).alias("all")))["all"]
    return F.zip_with(ends, found, lambda at, m: F.struct(at.alias("pos"), F.trim(m).alias("marker")))


def markers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, marker): every time marker with its place and the number of its pattern."""
    tagged = lambda k: lambda m: F.struct(m["pos"].alias("pos"), F.lit(k).alias("kind"), m["marker"].alias("marker"))
    found = F.concat(*[F.transform(places(F.col(text), p), tagged(k)) for k, p in enumerate(MARKERS)])
    return rows.select(key, F.inline(found))


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, chapter, timepoint, start, length, preview): a text cut at its markers; one section where it has none.

    Text before the first marker belongs to no section. The chapter is the first title line, else the key.
    """
    body = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    w = Window.partitionBy(key).orderBy("pos", "kind")
    cut = markers(body, key, "_text").withColumns({"no": F.row_number().over(w), "_next": F.lead("pos").over(w)})
    joined = body.join(cut, key, "left")
    title = F.regexp_extract("_text", TITLE, 1)
    start = F.coalesce("pos", F.lit(0))
    length = F.coalesce("_next", F.length("_text")) - start
    chapter = F.when(title != "", F.trim(title)).otherwise(F.col(key).cast("string"))
    return joined.select(key, F.coalesce("no", F.lit(1)).alias("no"), chapter.alias("chapter"), F.col("marker").alias("timepoint"), start.alias("start"), length.alias("length"), F.substring(F.col("_text"), start + 1, F.least(length, F.lit(PREVIEW))).alias("preview"))


def profiles(rows: DataFrame, text: str) -> DataFrame:
    """(name, age, appearance, hair, eyes, height, role, aliases) from profile texts; without a title there is no profile."""
    name = F.trim(F.regexp_extract(text, TITLE, 1))
    first = {k: F.nullif(F.trim(F.regexp_extract(text, "(?i)" + p, 1)), F.lit("")) for k, p in ATTRIBUTES.items()}
    aliases = F.filter(F.transform(F.split(F.regexp_extract(text, "(?i)" + ALIASES, 1), "[,;]"), lambda a: F.trim(a)), lambda a: a != "")
    return rows.select(name.alias("name"), *[c.alias(k) for k, c in first.items()], aliases.alias("aliases")).where("name <> ''")


def mentions(rows: DataFrame, key: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """(key, name): texts that have a name as whole words, in any case.

    Names are joined on their first word, so no text is held against every name; longer names are then looked for whole.
    """
    word = r"[\p{L}\p{N}_]+"
    low = names.select(F.col(name).alias("name"), F.lower(F.trim(name)).alias("_low")).where("_low <> ''").distinct().withColumn("_word", F.regexp_extract("_low", f"({word})", 1)).where("_word <> ''")
    words = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({word})"), F.lit(1)))).alias("_word"))
    hits = words.join(low, "_word")
    one = hits.where("_low = _word").select(key, "name")
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("_low"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    more = hits.where("_low <> _word").select(key, "name", "_low").join(rows.select(key, F.lower(text).alias("_t")), key).where(F.rlike(F.col("_t"), quoted)).select(key, "name")
    return one.unionByName(more).distinct()


def issues(rows: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, name, issue, detail): ages and colours that contradict a profile, and names in other capitals.

    known: profiles. Only texts that mention a name are held against its profile.
    """
    named = mentions(rows, key, text, known).join(rows.select(key, F.col(text).alias("_t")), key).join(known, "name")
    safe = F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E"))
    age = F.regexp_extract_all(F.col("_t"), F.concat(F.lit(r"(?i)\b"), safe, F.lit(r"\b[^.!?]*\b(\d+)[\s-](?:year|yr)")), F.lit(1))
    own = F.regexp_extract(F.coalesce("age", F.lit("")), r"\d+", 0)
    of = lambda kind, a: F.transform(a, lambda x: F.struct(F.lit(kind).alias("issue"), x.alias("detail")))
    found = [of("age", F.filter(age, lambda a: (own != "") & (a != own)))]
    for attribute in ("hair", "eyes"):
        told = F.lower(F.coalesce(attribute, F.lit("")))
        about = F.regexp_extract_all(F.col("_t"), F.concat(F.lit(r"(?i)\b"), safe, F.lit(rf"\b[^.!?]*\b{attribute}\b[^.!?]*")), F.lit(0))
        wrong = F.filter(about, lambda x: (told != "") & ~F.contains(F.lower(x), told) & F.lower(x).rlike(rf"\b({COLOURS})\b"))
        found.append(of(attribute, F.transform(wrong, lambda x: F.substring(x, 1, 100))))
    said = F.array_distinct(F.regexp_extract_all(F.col("_t"), F.concat(F.lit(r"(?i)\b"), safe, F.lit(r"\b")), F.lit(0)))
    found.append(of("capitals", F.filter(said, lambda x: x != F.col("name"))))
    return named.select(key, "name", F.inline(F.concat(*found)))


def by_character(sections: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(name, key, no, timepoint, preview) of the sections in which each known name occurs."""
    one = sections.withColumn("_k", F.concat_ws(":", F.col(key).cast("string"), F.col("no").cast("string")))
    return mentions(one, "_k", "preview", names).join(one, "_k").select("name", key, "no", "timepoint", "preview")
