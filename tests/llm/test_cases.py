"""Odd rows and clashing names through every operator and every stage of the pipeline."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from foliant.llm import chunk_bpe, context_mix, gif_media, line_spread, native_simhash, simhash_bk, token_store, toxicity, vector_pack, warc_index
from pyspark.sql import functions as F

#: Names that operators use for columns of their own, now or before.
NAMES = ["c0", "c1", "c2", "d", "t", "d0", "row", "row_d", "row_t", "node", "key", "set", "bands", "band", "lead", "label", "gone", "parts", "site", "line", "pos", "n", "n_lines", "n_gone", "s", "score", "rid", "fp", "q0", "chunk", "train", "tie", "size", "__d", "__t", "__gone", "__parts", "__lines", "__removed", "__toxicity", "_hot_found", "first", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
LONG = " ".join(f"word{i % 5000} of a very long text" for i in range(40_000))
LINE = "this line stands on the pages of many sites"
NEAR = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2


def rows():
    texts = [(1, "a b c"), (2, None), (3, ""), (None, "null id"), (None, "null id"), (None, None), (4, LONG), (5, "tie"), (6, "tie"), (7, "twice"), (7, "twice"), (7, "other text of the id"), (8, "  \t\n "), (9, "idiot scum"), (10, NEAR), (11, NEAR + "end")]
    texts += [(20 + i, f"{LINE}\nown words {i}") for i in range(4)]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k}", len(t or ""), *[f"{n}-{k}" for n in NAMES]) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    r = random.Random(3)
    common = sorted({w for _, t, *_ in rows() for w in (t or "")[:2000].split()} - {"idiot", "scum"})
    docs.unionByName(spark.createDataFrame([(1000 + i, "idiot scum " * 5 if i % 3 == 0 else " ".join(r.choices(common, k=r.randint(0, 40))), "en", "s", 1, *[""] * len(NAMES)) for i in range(300)], SCHEMA)).write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(300)] + [(9, 0, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base)


def plain(docs):
    return toxicity.train(["a b", "idiot scum", "c d", "idiot"] * 5, [0, 1, 0, 1] * 5)


OPERATORS = {
    "op1": lambda d: simhash_bk.group(d),
    "op2": lambda d: token_store.read(token_store.write(d, public_tokenizers.path("byte_bpe_50k.json"), 2)),
    "op3": lambda d: toxicity.score(d, plain(d), "how toxic"),
    "op4": lambda d: gif_media.digests(gif_media.store(d)),
    "op5": lambda d: native_simhash.edited(d),
    "op6": lambda d: chunk_bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "op7": lambda d: line_spread.clean(d, counts=("all lines", "lines gone")),
    "op8": lambda d: warc_index.read(warc_index.write(d.selectExpr("doc_id AS page_id", "text AS html", "source AS url", *[f"`{n}` AS `{n}`" for n in NAMES]))),
    "op9": lambda d: context_mix.score(d),
    "op10": lambda d: vector_pack.pack(d, public_tokenizers.path("word_bpe_49k.json")),
}
#: Rows beyond one a document: op10 cuts the long text.
MORE = {"op10"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, docs, name):
    out = OPERATORS[name](docs).collect()
    key = "page_id" if name == "op8" else "doc_id"
    want = sorted(-1 if r[0] is None else r[0] for r in rows())
    got = sorted(-1 if r[key] is None else r[key] for r in out if name not in MORE or r["piece"] == 0)
    assert got == want
    if name in ("op3", "op7"):  # extra columns pass unchanged
        told = sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[n] for n in NAMES]) for r in out)
        assert told == sorted((r[0] is None, r[0] or 0, *r[5:]) for r in rows())
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3", "op7"])
def test_taken_names_are_errors(docs, name):
    with pytest.raises(ValueError):
        toxicity.score(docs, plain(docs), "TEXT") if name == "op3" else line_spread.clean(docs, counts=("x", "Source"))


def test_equal_texts_have_equal_results(docs):
    for name, column in (("op1", "fingerprint"), ("op3", "how toxic"), ("op4", "feature"), ("op5", "fingerprint"), ("op6", "ids_sha256"), ("op9", "score")):
        told = {r["doc_id"]: r[column] for r in OPERATORS[name](docs).where("doc_id in (2, 3, 5, 6)").collect()}
        assert told[2] == told[3] and told[5] == told[6], name


def test_stages(spark, docs, folder):
    """Each stage on the odd rows: what goes, what stays, and the columns as they were."""
    given = {tuple(r)[5:] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept[name] = out.collect()
        assert {tuple(r)[5:] for r in kept[name]} <= given and len(kept[name]) <= docs.count()
        assert stage(spark, docs.limit(0), folder).count() == 0
    ids = {k: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in v) for k, v in kept.items()}
    every = sorted(-1 if r[0] is None else r[0] for r in rows())
    assert ids["toxicity"] == [i for i in every if i != 9]
    assert ids["line dedup"] == every
    texts = {r["doc_id"]: r["text"] for r in kept["line dedup"]}
    assert texts[20] == f"{LINE}\nown words 0" and texts[21] == "own words 1" and texts[2] is None and texts[4] == LONG
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept["line dedup"])
    # 2, 3, 8 and the null text without an id are empty; 6 repeats 5; 11 is near 10
    assert ids["near dedup"] == [-1, 1, 2, 4, 5, 7, 7, 9, 10, 20, 21, 22, 23]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert len(packed[packed["piece"] == 0]) == len(every) and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_whole_pipeline(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    first = out[out["piece"] == 0]["doc_id"]
    assert 9 not in set(first) and {1, 4, 10} <= set(first) and 11 not in set(first)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
