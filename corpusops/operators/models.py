"""Report model documents: flattening, references, search, checks and version diffs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.functions.text import bind
from corpusops.session import stored

TABLE_NAME = r"(?i)\b[RE]\d{3}\w+"
SQL_FRAGMENT = r"(?is)(?:SELECT|INSERT|UPDATE|DELETE|FROM|JOIN|WHERE).*?;"
MAX_KEYWORD_EXAMPLES = 5
SHOWN_CHARS = 3000
SPACES = r"\s+"
SPACES_HERE = r"[ \t\n\x0b\f\r]+"  # the same, as Arrow writes it
#: Bytes of text and (request, word) rows that meet in one task.
TILE_BYTES, TILE_WORDS = 8 << 20, 1 << 20
#: Entries of a table of words by files, and tokens written to it at once.
TILE_ENTRIES, TOKENS_AT_ONCE = 1 << 24, 1 << 18
#: Fingerprints of runs of bytes are polynomials in this.
RUN_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
RUN_BYTES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)

# Scalar fields and child fields compared between two versions.
DIFF_SCALARS = ["caption", "version", "orientation", "reportType", "formatReport"]
DIFF_CHILD = ["type", "name", "caption", "table", "field"]

# Band types a complete model has.
HEADER, DETAIL = "CABECALHO", "DETALHE"


def flatten(models: DataFrame) -> DataFrame:
    """One row per child; a band without children, and a model without bands, keep one row."""
    bands = models.select("filename", F.posexplode_outer("bands").alias("band_no", "band"))
    return bands.select(
        "filename", "band_no", F.col("band.name").alias("band"), F.col("band.bandType").alias("band_type"),
        F.col("band.tag").alias("tag"), F.posexplode_outer("band.children").alias("child_no", "child"),
    ).select("filename", "band_no", "band", "band_type", "tag", "child_no", "child.*")


def _found(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda t: F.upper(t))


def _joined(lists: Column) -> Column:
    """One list of all that are there; a missing list counts as empty."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def references(models: DataFrame, pattern: str = TABLE_NAME) -> DataFrame:
    """Per model its tables (sorted) and SQL fragments; everything stays inside the row."""
    sources = F.map_values("sections")
    from_rules = F.flatten(F.transform(sources, lambda s: _found(s, pattern)))
    children = _joined(F.transform("bands", lambda b: b["children"]))
    from_children = F.flatten(
        F.transform(
            children,
            lambda c: F.filter(
                F.array(F.upper(c["table"]), F.upper(F.nullif(F.split(c["tableField"], r"\.")[0], F.lit("")))),
                lambda t: t.isNotNull(),
            ),
        )
    )
    from_bands = _joined(F.transform("bands", lambda b: F.transform(b["tableList"], lambda t: F.upper(t))))
    empty = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(c, empty) for c in (from_rules, from_children, from_bands)])
    fragments = F.flatten(
        F.transform(sources, lambda s: F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(SQL_FRAGMENT), F.lit(0)))
    )
    return models.select(
        "filename",
        F.array_sort(F.array_distinct(every)).alias("tables_referenced"),
        F.coalesce(fragments, empty).alias("sql_fragments"),
    )


def name_parts(name: Column) -> tuple[Column, Column, Column]:
    """number, category and code of ``NN-category_CODE.json``."""
    bare = F.regexp_replace(name, r"\.json", "")
    head = F.substring_index(bare, "_", 1)
    category = F.when(head.contains("-"), F.regexp_replace(head, "^[^-]*-", "")).otherwise("")
    code = F.when(bare.contains("_"), F.regexp_replace(bare, "^[^_]*_", "")).otherwise("")
    return F.substring_index(head, "-", 1), category, code


def search(files: DataFrame, keyword: str | None = None, category: str | None = None) -> DataFrame:
    """Files (name, content) by category in the name and keyword in name or content."""
    keep = F.lit(True)
    low = F.lower("name")
    if category:
        keep = keep & low.contains(category.lower())
    if keyword:
        keep = keep & (low.contains(keyword.lower()) | F.lower("content").contains(keyword.lower()))
    number, cat, code = name_parts(F.col("name"))
    return files.filter(keep).select(
        F.col("name").alias("filename"), number.alias("number"), cat.alias("category"), code.alias("model_code")
    )


def get_model(files: DataFrame, name: str) -> DataFrame:
    if "/" in name or "\\" in name or ".." in name:
        raise ValueError("a model is named without a path")
    return files.filter(F.col("name") == name).limit(1)


def keyword_topk(files: DataFrame, requests: DataFrame, limit: int = MAX_KEYWORD_EXAMPLES) -> DataFrame:
    """Per request the files holding most of its words, ties by name; content cut for display.

    requests: request_id, text. Their words are split at white space, a repeated word counting again; a
    file holds a word where it stands in its name or content, in lower case.

    Files are dealt into blocks of bounded size and meet the requests there, so each text moves once and neither
    (request, file) pairs nor (file, word) ones are rows; a tile keeps its best ``limit`` files per request.
    Files without a word are no result; of a request that starts or ends with white space the empty word is in
    every file. A null text asks for nothing.
    """
    limit = min(MAX_KEYWORD_EXAMPLES, limit)
    asked = stored(
        requests.select(F.col("request_id").cast("string").alias("request_id"), F.explode(F.split(F.lower("text"), SPACES, -1)).alias("word"))
        .groupBy("request_id", "word").agg(F.count(F.lit(1)).alias("n")), "asked"
    )
    texts = files.select("name", F.lower(F.concat_ws("\n", "name", "content")).alias("text"))
    scored = _scored_tiles(texts, asked.where("word <> ''"), limit)
    empty = asked.where("word = ''").select("request_id", F.col("n").alias("always"))
    first = files.select("name").distinct().orderBy("name").limit(limit)  # stand in where no more files hold a word
    fillers = empty.crossJoin(F.broadcast(first)).select("request_id", "name", F.lit(0).cast("long").alias("score"))
    both = scored.unionByName(fillers).groupBy("request_id", "name").agg(F.max("score").alias("score"))
    both = both.join(empty, "request_id", "left").withColumn("score", F.col("score") + F.coalesce("always", F.lit(0)))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "name")
    top = stored(both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit), "top")
    return files.select("name", "content").join(top, "name").select(
        "request_id", "rank", "name", "score",
        F.when(
            F.length("content") > SHOWN_CHARS,
            F.concat(F.substring("content", 1, SHOWN_CHARS), F.lit("...(truncated)")),
        ).otherwise(F.col("content")).alias("shown"),
    )


def _scored_tiles(texts: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """request_id, name, score: the best ``limit`` files (name, text) per request (request_id, word, n), block and share."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    shares = max(1, -(-asked.count() // TILE_WORDS))
    blocks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // TILE_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = texts.select("name", "text", dealt("name", blocks).alias("block"), every(shares).alias("share"))
    right = asked.select("request_id", "word", "n", dealt("request_id", shares).alias("share"), every(blocks).alias("block"))

    def tile(files: pa.Table, requests: pa.Table) -> pa.Table:
        requests, files = requests.sort_by("request_id"), files.sort_by("name")  # ties go to the first name
        ids, words = (requests[c].combine_chunks().dictionary_encode() for c in ("request_id", "word"))
        asks = np.split(words.indices.to_numpy(), np.flatnonzero(np.diff(ids.indices.to_numpy())) + 1)
        times = np.split(requests["n"].to_numpy(), np.cumsum([len(x) for x in asks])[:-1])
        inside = _words_inside(words.dictionary.to_pylist())
        step = max(1, TILE_ENTRIES // max(1, len(words.dictionary)))
        out: list[tuple[int, int, int]] = []
        for at in range(0, len(files) if len(requests) else 0, step):
            parts = pc.split_pattern_regex(files["text"].slice(at, step).combine_chunks(), SPACES_HERE)
            tokens = pc.list_flatten(parts).dictionary_encode()
            holder, flat = inside(tokens.dictionary)
            lengths = np.bincount(holder, minlength=len(tokens.dictionary))
            first = np.cumsum(lengths) - lengths
            token, file = tokens.indices.to_numpy(), pc.list_parent_indices(parts).to_numpy()
            has = np.zeros((len(words.dictionary), len(parts)), np.float32)
            for a in range(0, len(token), TOKENS_AT_ONCE):
                t, f = token[a : a + TOKENS_AT_ONCE], file[a : a + TOKENS_AT_ONCE]
                n = lengths[t]
                has[flat[np.repeat(first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(f, n)] = 1
            for q, (own, n) in enumerate(zip(asks, times)):
                score = (n.astype(np.float32) @ has[own]).astype(np.int64)
                best = np.flatnonzero(score >= np.partition(score, -limit)[-limit]) if len(score) > limit else np.arange(len(score))
                best = best[np.argsort(-score[best], kind="stable")[:limit]]
                out += [(q, at + f, s) for f, s in zip(best.tolist(), score[best].tolist()) if s]
        q, f, s = (pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [])))
        return pa.table({"request_id": ids.dictionary.take(q), "name": files["name"].take(f), "score": s})

    keys = ["block", "share"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "request_id string, name string, score long")


def _runs(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprints of all runs of ``width`` bytes, from those of the powers of two it is made of."""
    power, factor, at = RUN_BYTES[data], RUN_BASE.copy(), 0
    value = np.zeros(len(data) - width + 1, np.uint64)
    for k in range(width.bit_length()):
        if width >> k & 1:
            value = value * factor + power[at : at + len(value)]
            at += 1 << k
        if width >> k > 1:
            power = power[: -(1 << k)] * factor + power[1 << k :]
            factor = factor * factor
    return value


def _words_inside(words: list[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Finds the words (by number) inside tokens: pairs of a token's and a word's number, by token. A word holds no white
    space, so it stands inside one token. The words of a size are met by the fingerprints of all runs of that many
    bytes in the tokens that are long enough, and what meets is compared byte by byte."""
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    sizes: dict[int, list[int]] = {}
    for i, w in enumerate(raw):
        sizes.setdefault(len(w), []).append(i)
    layers = []  # (size, leading bits and sorted values of fingerprints, numbers and bytes of their words), no fingerprint twice
    for k, own in sorted(sizes.items()):
        prints, own = np.array([_runs(raw[i], k)[0] for i in own], np.uint64), np.array(own)
        while len(own):
            values, first = np.unique(prints, return_index=True)
            marked = np.zeros(1 << 16, bool)
            marked[values >> np.uint64(48)] = True
            layers.append((k, marked, values, own[first], np.stack([raw[i] for i in own[first]])))
            prints, own = np.delete(prints, first), np.delete(own, first)

    def inside(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths = pc.binary_length(tokens).to_numpy().astype(np.int64)
        data = np.frombuffer("".join(tokens.to_pylist()).encode(), np.uint8)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        left = np.cumsum(lengths)[owner] - np.arange(len(data))
        found, size = [], 0
        for k, marked, values, numbers, content in layers:
            if k > len(data):
                break
            if k != size:
                size, prints = k, _runs(data, k)
            start = np.flatnonzero(marked[prints >> np.uint64(48)] & (left[: len(prints)] >= k))
            at = np.minimum(np.searchsorted(values, prints[start]), len(values) - 1)
            start, at = (x[values[at] == prints[start]] for x in (start, at))
            same = (data[start[:, None] + np.arange(k)] == content[at]).all(axis=1)
            found.append(owner[start[same]] * len(words) + numbers[at[same]])
        pairs = np.sort(np.concatenate([np.empty(0, np.int64), *found]))
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        return pairs // max(1, len(words)), pairs % max(1, len(words))

    return inside


def pick_examples(files: DataFrame, categories: list[str], defaults: list[str], limit: int) -> DataFrame:
    """The first file of each wanted category, then default files up to ``limit``."""
    wanted = F.filter(
        F.lit([f"{i}|{c}" for i, c in enumerate(categories)]),
        lambda e: F.contains(F.col("name"), F.substring_index(e, "|", -1)),
    )
    first = (
        files.select("name", F.explode(wanted).alias("e")).groupBy("e").agg(F.min("name").alias("name"))
        .select(
            F.substring_index("e", "|", 1).cast("int").alias("pos"), "name",
            F.substring_index("e", "|", -1).alias("category"),
        )
    )
    fallback = files.filter(F.col("name").isin(defaults)).select(
        (F.array_position(F.lit(defaults), F.col("name")).cast("int") + 1_000_000).alias("pos"), "name",
        F.lit("default").alias("category"),
    )
    spare = fallback.join(F.broadcast(first.select("name")), "name", "left_anti").select("pos", "name", "category")
    room = max(0, limit)
    # one row per category or default: a few rows
    chosen = first.unionByName(spare)
    ranked = chosen.withColumn("n", F.row_number().over(Window.orderBy("pos", "name")))
    return ranked.filter((F.col("category") != "default") | (F.col("n") <= room)).drop("pos")


def validate(models: DataFrame, known: DataFrame) -> DataFrame:
    """Issues (filename, severity, message) of every model; known: table."""
    types = F.transform("bands", lambda b: b["bandType"])
    n = F.coalesce(F.size("bands"), F.lit(0))

    def issue(when: Column, severity: str, message: str) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))

    def lacks(kind: str) -> Column:
        return ~F.coalesce(F.array_contains(types, kind), F.lit(False))

    checks = F.filter(
        F.array(
            issue(n <= 0, "error", "No bands defined"),
            issue(lacks(HEADER), "warning", f"No {HEADER} band (page header)"),
            issue(lacks(DETAIL), "error", f"No {DETAIL} band (data rows)"),
        ),
        lambda i: i.isNotNull(),
    )
    structural = models.select("filename", F.explode(checks).alias("i")).select("filename", "i.*")
    bound = flatten(models).filter((F.col("type") == "TSCadastro") & (F.coalesce("table", F.lit("")) != ""))
    names = known.select(F.col("table").alias("k")).distinct()
    unknown = bound.join(
        names, (F.upper("table") == F.col("k")), "left_anti"
    ).select(
        "filename", F.lit("warning").alias("severity"),
        F.concat(F.lit("TSCadastro "), F.col("name"), F.lit(': table "'), F.col("table"), F.lit('" not found')).alias("message"),
    )
    return structural.unionByName(unknown)


def _unequal(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _entry(when: Column, path: Column, a: Column, b: Column) -> Column:
    return F.when(
        when, F.struct(path.alias("path"), a.cast("string").alias("before"), b.cast("string").alias("after"))
    )


CHILDREN = f"array<struct<{', '.join(f'{k}:string' for k in DIFF_CHILD)}>>"


def _section(text: Column) -> Column:
    said = F.trim(F.coalesce(text, F.lit("")))
    return F.struct(F.sha2(said, 256).alias("sha256"), F.length(said).alias("length"))


def _compared(models: DataFrame, name: str) -> DataFrame:
    """filename and, as ``name``, what ``diff`` looks at, written small."""
    def band(b: Column) -> Column:
        children = F.transform(b["children"], lambda c: F.when(c.isNotNull(), F.struct(*[c[k].cast("string").alias(k) for k in DIFF_CHILD])))
        n = F.greatest(F.coalesce(F.size(b["children"]), F.lit(0)), F.lit(0))
        return F.when(b.isNotNull(), F.struct(b["name"].alias("name"), b["tag"].alias("tag"), b["bandType"].alias("bandType"), n.alias("n"), F.to_json(children).alias("children")))

    kept = [c for c in DIFF_SCALARS if c in models.columns]
    if "sections" in models.columns:
        kept.append(F.transform_values("sections", lambda _, text: _section(text)).alias("sections"))
    return models.select("filename", F.struct(*kept, F.transform("bands", band).alias("bands")).alias(name))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences (filename, path, before, after) of models that exist in both versions.

    Bands and children are compared by position as far as both versions reach. The two versions
    meet in one row, so each model costs one join on its name and no exploding of equal parts. What is shuffled
    is what is compared: of a section its hash and length, of a band its children as one JSON text, which is read
    again only where the two texts are not the same.
    """
    pair = _compared(before, "a").join(_compared(after, "b"), "filename")
    ca, cb = F.col("a"), F.col("b")

    nothing = F.lit(None).cast("struct<path:string,before:string,after:string>")

    def size(x: Column) -> Column:
        return F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))

    scalars = [
        _entry(_unequal(ca[k], cb[k]), F.lit(k), ca[k], cb[k]) for k in DIFF_SCALARS if k in before.columns
    ]
    parts = [F.array(*scalars)]
    if "sections" in before.columns:
        def section(side: Column, k: Column) -> Column:
            return F.coalesce(F.try_element_at(side["sections"], k), _section(F.lit("")))

        parts.append(
            F.transform(
                F.map_keys(ca["sections"]),
                lambda k: _entry(
                    _unequal(section(ca, k), section(cb, k)), F.concat(F.lit("sections."), k, F.lit(".length")),
                    section(ca, k)["length"], section(cb, k)["length"],
                ),
            )
        )
    na, nb = size(ca["bands"]), size(cb["bands"])
    parts.append(F.array(_entry(na != nb, F.lit("bands.length"), na, nb)))

    def positions(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def band_entries(i: Column) -> Column:
        x, y = F.get(ca["bands"], i), F.get(cb["bands"], i)
        at = F.concat(F.lit("bands["), i, F.lit("]."))
        own = [_entry(_unequal(x[k], y[k]), F.concat(at, F.lit(k)), x[k], y[k]) for k in ("name", "tag", "bandType")]
        mx, my = (F.coalesce(v["n"], F.lit(0)) for v in (x, y))
        own.append(_entry(mx != my, F.concat(at, F.lit("children.length")), mx, my))

        def child_entries(j: Column, xs: Column, ys: Column) -> Column:
            p, q = F.get(xs, j), F.get(ys, j)
            where = F.concat(at, F.lit("children["), j, F.lit("]."))
            entries = F.array(
                *[_entry(_unequal(p[k], q[k]), F.concat(where, F.lit(k)), p[k], q[k]) for k in DIFF_CHILD]
            )
            return F.when(_unequal(p, q), entries).otherwise(F.array(nothing))

        def children(of: Column) -> Column:
            listed = F.flatten(F.transform(positions(F.least(mx, my)), lambda j: child_entries(j, of["x"], of["y"])))
            return F.when(_unequal(x["children"], y["children"]), listed).otherwise(F.array(nothing))

        read = F.struct(F.from_json(x["children"], CHILDREN).alias("x"), F.from_json(y["children"], CHILDREN).alias("y"))
        return F.when(_unequal(x, y), F.concat(F.array(*own), bind(read, children))).otherwise(F.array(nothing))

    parts.append(F.flatten(F.transform(positions(F.least(na, nb)), band_entries)))
    found = F.filter(F.concat(*parts), lambda e: e.isNotNull())
    return pair.select("filename", F.explode(found).alias("d")).select("filename", "d.*")


def error_stats(errors: DataFrame, message: str, limit: int = 20) -> DataFrame:
    """Most frequent messages by their first 60 characters."""
    return (
        errors.groupBy(F.coalesce(F.substring(message, 1, 60), F.lit("unknown")).alias("message"))
        .agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "message").limit(limit)
    )


def parse_outcomes(models: DataFrame) -> DataFrame:
    """How many models were read in full, in part or not at all."""
    return models.agg(
        F.count_if(F.col("_stats.parseComplete")).alias("ok"),
        F.count_if(~F.col("_stats.parseComplete")).alias("partial"),
        F.count_if(F.col("_stats").isNull()).alias("failed"),
    )
