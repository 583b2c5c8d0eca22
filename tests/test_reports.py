"""Reports, trees, bands, history, model mining, layouts and golden sets on small fixtures."""

import itertools
import json
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusops.functions import scalar as fn
from corpusops.operators import bands, hierarchy, history, layout, modelkb, models, templates
from corpusops.operators import evaluation as ev
from corpusops.operators import golden as gold
from corpusops.operators import requests as req
from corpusops.operators import rule_corpus as corpus
from corpusops.operators.hierarchy import tree_paths
from corpusops.session import stored
from corpusops.sources import files, sinks


def test_tree(spark):
    n = 14
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(n)] + [(50, "cyc"), (51, "cyc2"), (60, "lost")], "id int, name string")
    links = spark.createDataFrame(
        [(i, i - 1) for i in range(1, n)] + [(3, 0), (50, 51), (51, 50), (60, 99), (None, 0)], "c int, p int")
    got = sorted((r["level"], r["path"]) for r in tree_paths(nodes, links, "id", "name", "c", "p").collect())
    down = [" > ".join(f"n{j}" for j in range(i + 1)) for i in range(11)]
    short = [" > ".join(["n0"] + [f"n{j}" for j in range(3, i + 1)]) for i in range(3, n) if i - 2 <= 10]
    assert got == sorted([(p.count(">"), p) for p in down + short])


def test_templates_on_their_own_tables(spark):
    frames = {
        "r034fun": spark.createDataFrame(
            [(1, 1, i, f"name {i}", 1, 5 if i % 2 else None, 1, 7, "1", "2020-01-01", i) for i in range(150)] + [(2, 1, 1, "other", 1, 5, 1, 7, "1", "2020", 1)],
            "NumEmp int, TipCol int, NumCad int, NomFun string, TabOrg int, NumLoc int, EstCar int, CodCar int, SitAfa string, DatAdm string, CodPes int"),
        "r030emp": spark.createDataFrame([(1, "ACME")], "NumEmp int, NomEmp string"),
        "r016orn": spark.createDataFrame([(1, 5, "Unit")], "TabOrg int, NumLoc int, NomLoc string"),
        "r024car": spark.createDataFrame([(1, 7, "Job", "J")], "EstCar int, CodCar int, TitCar string, TitRed string"),
    }
    out = templates.run_template(frames.__getitem__, "employee-roster", numemp="1").collect()
    assert len(out) == 100 and [r["NumCad"] for r in out] == list(range(100))
    assert out[0]["NomLoc"] is None and out[1]["NomLoc"] == "Unit" and out[0]["NomEmp"] == "ACME"
    with pytest.raises(templates.MissingParameter):
        templates.bind({"a": None}, {"b": 1})
    hostile = templates.run_sql(spark, "SELECT count(*) AS n FROM {t} WHERE NomEmp = :name", {"name": "x"},
                                {"NAME": "' OR '1'='1"}, t=frames["r030emp"])
    assert hostile.first()["n"] == 0


def test_running_total_and_scopes(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i // 7, i, i * 2) for i in range(60)], "k string, d int, i int, v long")
    got = bands.running_total(df, ["k"], ["d", "i"], F.col("v"), F.floor(F.col("d") / 3))
    want, sums = {}, Counter()
    for r in sorted(df.collect(), key=lambda r: (r["d"], r["i"])):
        sums[r["k"]] += r["v"]
        want[r["i"]] = sums[r["k"]]
    assert {r["i"]: r["running"] for r in got.collect()} == want
    assert bands.scope_ranges("20,18-25, 1-3,4,9") == [(1, 4), (9, 9), (18, 25)]
    with pytest.raises(ValueError):
        bands.scope_ranges("1-x")


def test_as_of(spark):
    h = spark.createDataFrame(
        [(1, "2024-01-01", "a"), (1, "2024-02-01", "b"), (1, "2024-02-01", "c"), (1, "2024-05-01", "d"), (2, "2024-06-01", "e")],
        "k int, d string, v string")
    got = {r["v"] for r in history.as_of(h, ["k"], "d", F.lit("2024-03-01")).collect()}
    assert got == {"b", "c"}


def brute_pairs(reports):
    counts = Counter()
    for tables in reports.values():
        counts.update(itertools.combinations(sorted(tables), 2))
    return counts


@pytest.mark.parametrize("wide_at", [2, 6, 256])
def test_pairs_with_wide_reports(spark, wide_at):
    rnd = random.Random(5)
    names = [f"R{i:03d}" for i in range(40)]
    reports = {f"m{i}": set(rnd.sample(names, rnd.choice([1, 2, 3, 4, 20, 30]))) for i in range(40)}
    refs = spark.createDataFrame([(r, t, i) for r, ts in reports.items() for i, t in enumerate(sorted(ts))], "report string, table string, pos int")
    counts = brute_pairs(reports)
    want = sorted(((n, a, b) for (a, b), n in counts.items()), key=lambda x: (-x[0], x[1], x[2]))
    for limit in (5, 60, 200):
        got = [(r["reports"], r["a"], r["b"]) for r in modelkb.top_pairs(refs, limit, wide_at).collect()]
        assert got == want[:limit]
    both = Counter()
    for (a, b), n in counts.items():
        both[a, b] = both[b, a] = n
    best = {}
    for (a, b), n in sorted(both.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        best.setdefault(a, []).append((b, n))
    got = {}
    for r in modelkb.common_joins(refs, 8, wide_at).orderBy("table", "rank").collect():
        got.setdefault(r["table"], []).append((r["other"], r["reports"]))
    assert got == {a: v[:8] for a, v in best.items()}


def test_pairs_of_many_wide_reports(spark, monkeypatch):
    """Twenty wide reports, one of them holding every table, over blocks of a few tables."""
    rnd = random.Random(8)
    names = [f"R{i:03d}" for i in range(90)]
    reports = {f"w{i:02d}": set(names if i == 0 else rnd.sample(names, rnd.randint(12, 70))) for i in range(20)}
    reports |= {f"n{i:02d}": set(rnd.sample(names, rnd.randint(1, 5))) for i in range(60)}
    reports["x"] = {"R000", "S1", "S2"}  # tables that no wide report names
    refs = spark.createDataFrame([(r, t, i) for r, ts in reports.items() for i, t in enumerate(sorted(ts))], "report string, table string, pos int")
    counts = brute_pairs(reports)
    ranked = sorted(counts, key=lambda p: (-counts[p], p))
    both = Counter({**counts, **{(b, a): n for (a, b), n in counts.items()}})
    best = {}
    for a, b in sorted(both, key=lambda p: (p[0], -both[p], p[1])):
        best.setdefault(a, []).append((b, both[a, b]))
    for tables in (2048, 17):
        monkeypatch.setattr(modelkb, "BLOCK_TABLES", tables)
        got = [(r["a"], r["b"], r["reports"]) for r in modelkb.top_pairs(refs, 300, 10).collect()]
        assert got == [(*p, counts[p]) for p in ranked[:300]]
        got = {}
        for r in modelkb.common_joins(refs, 8, 10).orderBy("table", "rank").collect():
            got.setdefault(r["table"], []).append((r["other"], r["reports"]))
        assert got == {a: v[:8] for a, v in best.items()}


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """Tasks follow the number of pairs; references that repeat count again, null ones never."""
    rnd = random.Random(12)
    rows = [(rnd.randint(1, 150), f"R{rnd.randint(0, 60):03d}") for _ in range(900)] + [(None, "R001"), (None, "R002"), (3, None)]
    want = Counter((x, y) for i, x in rows for j, y in rows if i is not None and i == j and x and y and x < y)
    monkeypatch.setattr(modelkb, "PAIRS_AT_ONCE", 100)
    refs = spark.createDataFrame(rows, "report int, table string")
    narrow, wide, n = modelkb._split(refs, 256)
    found = modelkb._narrow_pairs(narrow, n).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.a, r.b): r.n for r in found} == want and wide.count() == 0
    assert sum(want.values()) <= n < 1.2 * sum(want.values())
    assert max(Counter(r.task for r in found).values()) < 300


def test_words_inside_tokens(monkeypatch):
    """Pairs of tokens and the words in them against a plain search, with good fingerprints and with bad ones."""
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abcé漢") for _ in range(rnd.randint(0, n)))
    words = sorted({some(9) for _ in range(150)} - {""} | {"a" * 40, "ab" * 300})
    tokens = sorted({some(14) for _ in range(200)} | {"", "a" * 50, "ab" * 301})
    want = [(i, j) for i, t in enumerate(tokens) for j, w in enumerate(words) if w in t]
    for base in (models.RUN_BASE, models.RUN_BASE * 0):
        monkeypatch.setattr(models, "RUN_BASE", base)
        for own in (tokens, [], [""]):
            got = [*zip(*(x.tolist() for x in models._words_inside(words)(pa.array(own, pa.string()))))]
            assert got == [(i, j) for i, t in enumerate(own) for j, w in enumerate(words) if w in t]
    assert len(want) > 300 and not len(models._words_inside([])(pa.array(tokens))[0])


def test_keyword_topk(spark, monkeypatch):
    rnd = random.Random(21)
    syllables = ["ba", "lo", "ri", "é", "x", "Tu", "nda", "q"]
    word = lambda n: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, n)))
    files = [(f"{i:03d}-{word(3)}.json", " ".join(word(5) for _ in range(rnd.randint(0, 40)))) for i in range(80)]
    files += [("empty", ""), ("none", None), ("long", "ba" * 5000 + " " + "lo " * 2000), ("same-1", files[3][1]), ("same-2", files[3][1])]
    asked = [(f"q{i}", " ".join(word(3) for _ in range(rnd.randint(1, 12)))) for i in range(30)]
    asked += [("spaces", "  ba  ba\tlo "), ("blank", ""), ("nothing", "zzz zzzz"), ("null", None), ("name", "same-1 .json"), ("UPPER", "BA É TU")]

    def want(text):
        words = re.split(r"[ \t\n\x0b\f\r]+", text.lower())
        scores = [(sum(w in f"{n}\n{c or ''}".lower() for w in words), n) for n, c in files]
        best = sorted(((-s, n) for s, n in scores if s))[:5]
        return [(k + 1, n, -s) for k, (s, n) in enumerate(best)]

    f = spark.createDataFrame(files, "name string, content string").repartition(3)
    q = spark.createDataFrame(asked, "request_id string, text string").repartition(2)
    for rows in (1 << 20, 50):
        monkeypatch.setattr(models, "TILE_WORDS", rows)
        found = models.keyword_topk(f, q).orderBy("request_id", "rank").collect()
        got = {}
        for r in found:
            got.setdefault(r.request_id, []).append((r["rank"], r.name, r.score))
        assert got == {i: want(t) for i, t in asked if t is not None and want(t)}
    assert {r.shown[-14:] for r in found if r.name == "long"} <= {"...(truncated)"}
    assert models.keyword_topk(f.limit(0), q).count() == 0 and models.keyword_topk(f, q.limit(0)).count() == 0


def test_deep_tree_in_few_rounds(spark, monkeypatch):
    """A chain of 1,000 nodes, a cycle, and a node on a cycle that also hangs on a root."""
    rounds = []
    monkeypatch.setattr(hierarchy, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1100)], "id int, name string")
    links = [(i, i - 1) for i in range(1, 1000)] + [(1001, 1002), (1002, 1001), (1003, 1004), (1004, 1003), (1003, 0), (1005, None), (1006, 5000)]
    links = spark.createDataFrame(links, "c int, p int")
    got = {r.node: r for r in tree_paths(nodes, links, "id", "name", "c", "p", 999).filter("node < 1000").collect()}
    assert len(rounds) == 11 and len(got) == 1000  # the first table and ten rounds
    for i in (0, 1, 2, 511, 512, 999):
        assert got[i].level == i and got[i].chain == [str(k) for k in range(i + 1)] and got[i].path == " > ".join(f"n{k}" for k in range(i + 1))
    few = sorted((r.node, r.level, r.parent) for r in tree_paths(nodes, links, "id", "name", "c", "p", 5).filter("node < 10 or node > 1000 and node < 1007").collect())
    assert few == [(0, 0, None), (1, 1, 0), (2, 2, 1), (3, 3, 2), (4, 4, 3), (5, 5, 4), (1003, 1, 0), (1003, 3, 1004), (1003, 5, 1004), (1004, 2, 1003), (1004, 4, 1003)]


def test_picked_texts_are_not_aggregated(spark):
    rows = spark.createDataFrame([(f"u{i // 3}", f"g{i % 4}", "t" * (i % 7 + 1), f"c{i:02d}") for i in range(60)], "url string, g string, text string, chunk_id string")
    picked = gold.round_robin(rows, F.col("g"), "url", 10, [F.length("text") * -1, F.col("chunk_id")])
    best = {}
    for r in rows.collect():
        best[r.url] = min(best.get(r.url, r), r, key=lambda x: (-len(x.text), x.chunk_id))
    turns, want = {}, []
    for r in sorted(best.values(), key=lambda x: (-len(x.text), x.chunk_id)):
        turns[r.g] = turns.get(r.g, 0) + 1
        want.append((turns[r.g], r.g, r.url, r.chunk_id))
    assert [(r["round"], r.grp, r.url, r.chunk_id) for r in sorted(picked.collect(), key=lambda r: r.n)] == sorted(want)[:10]
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "text#" not in aggregate and "RangePartitioning" not in plan


def test_scopes_of_any_length(spark):
    rnd = random.Random(3)
    ranges = {"short": [(1, 5), (8, 8)], "long": [(0, 10**12)], "low": [(-70, -3), (-1, 0)], "ends": [(-(2**61), -(2**40)), (2**40, 2**61)], "none": [(5, 4)], "null": [(None, 9)]}
    for i in range(20):
        a = rnd.randint(-300, 300)
        ranges[f"r{i}"] = [(a, a + rnd.randint(0, 200))]
    values = [*range(-310, 520), 10**12, 10**12 + 1, 2**40, 2**40 - 1, -(2**61), 2**61, 2**61 + 1, None]
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    bounds = spark.createDataFrame([(k, lo, hi) for k, own in ranges.items() for lo, hi in own], "scope_id string, lo long, hi long")
    got = sorted((r.scope_id, r.v) for r in bands.scopes_join(rows, "v", bounds).collect())
    assert got == sorted((k, v) for k, own in ranges.items() for v in values for lo, hi in own if v is not None and lo is not None and lo <= v <= hi)
    halves = rows.select((F.col("v") + 0.5).alias("v")).where("v between 0 and 10")
    got = sorted(r.v for r in bands.scopes_join(halves, "v", bounds.where("scope_id = 'short'")).collect())
    assert got == [1.5, 2.5, 3.5, 4.5]
    assert bands.scopes_join(rows, "v", bounds.limit(0)).count() == 0


def test_field_dictionary(spark):
    lines = ["R034FUN|NUMEMP|Empresa|2|4,0", "--------|---", "(12 rows affected)", "R034FUN|NOMFUN| Nome |1|", "x|y|z|1|2", "R1|F|t|77|abc", "R2|only|three", "R3||none|1|2"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r["table"], r["field"]): (r["type"], r["size"], r["description"]) for r in modelkb.field_dictionary(df).collect()}
    assert got == {("R034FUN", "NUMEMP"): ("numeric", 4, "Empresa"), ("R034FUN", "NOMFUN"): ("alpha", 0, "Nome"), ("R1", "F"): ("77", 0, "t")}


MODEL = {
    "filename": "x.json", "version": "3", "caption": "First", "orientation": "Portrait",
    "sections": {"selection": "SELECT * FROM R034FUN, e001xyz;\nx = 1;"},
    "bands": [
        {"name": "H", "bandType": "CABECALHO", "tag": 1, "tableList": ["r010sit"], "children": []},
        {"name": "D", "bandType": "DETALHE", "tag": 200, "children": [
            {"type": "TSCadastro", "name": "f1", "table": "R034FUN", "field": "NumCad", "tableField": "R036DEP.X"},
            {"type": "TSCadastro", "name": "f2", "table": "R999ZZZ"}]},
    ],
}


def test_models(spark, tmp_path):
    other = json.loads(json.dumps(MODEL)) | {"caption": "Second"}
    other["bands"][1]["children"][0]["name"] = "g1"
    other["bands"].append({"name": "T", "bandType": "SUBTOTAL", "tag": 300, "children": []})
    for folder, m in (("a", MODEL), ("b", other)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "01-simple_X.json").write_text(json.dumps(m, indent=2), encoding="utf-8")
    (tmp_path / "a" / "02-none_Y.json").write_text(json.dumps({"filename": "y.json", "bands": []}), encoding="utf-8")
    a, b = (files.read_models(spark, str(tmp_path / f)) for f in "ab")
    refs = models.references(a.filter("filename = 'x.json'")).first()
    assert refs["tables_referenced"] == ["E001XYZ", "R010SIT", "R034FUN", "R036DEP", "R999ZZZ"]
    assert refs["sql_fragments"] == ["SELECT * FROM R034FUN, e001xyz;"]
    known = spark.createDataFrame([("R034FUN",)], "table string")
    issues = sorted((r["filename"], r["severity"], r["message"]) for r in models.validate(a, known).collect())
    assert issues == [
        ("x.json", "warning", 'TSCadastro f2: table "R999ZZZ" not found'), ("y.json", "error", "No DETALHE band (data rows)"),
        ("y.json", "error", "No bands defined"), ("y.json", "warning", "No CABECALHO band (page header)")]
    diff = sorted(tuple(r) for r in models.diff(a, b).collect())
    assert diff == [
        ("x.json", "bands.length", "2", "3"), ("x.json", "bands[1].children[0].name", "f1", "g1"), ("x.json", "caption", "First", "Second")]
    assert models.flatten(a).count() == 4
    with pytest.raises(ValueError):
        models.get_model(a, "../x")


def test_pick_examples_and_requests(spark):
    f = spark.createDataFrame([("01-simple-list_A.json",), ("02-simple-list_B.json",), ("04-break-report_C.json",), ("15-multi-detail_D.json",)], "name string")
    got = [r["name"] for r in models.pick_examples(f, ["break-report", "none"], ["01-simple-list_A.json", "04-break-report_C.json", "15-multi-detail_D.json"], 2).orderBy("n").collect()]
    assert got == ["04-break-report_C.json", "01-simple-list_A.json"]
    df = spark.createDataFrame([("Total por empresa de funcionários ativos em paisagem",), ("lista de dependentes com soma",), ("lista",)], "t string")
    flags = req.flags(F.col("t"))
    cats = df.select(req.categories(flags["breaks"], flags["totals"], flags["rules"], flags["multi_detail"]), req.table_hits(F.col("t"))).collect()
    assert cats[0][0] == ["break-report", "total-report", "complex-rules"] and cats[0][1] == ["R034FUN", "R030EMP"]
    assert cats[1][0] == ["multi-detail"] and cats[2][0] == ["simple-list"]


def test_layout(spark, tmp_path):
    lines = ["Data;Valor;Nome", "01/02/2024;R$ 1.000,50;Ana", "Grupo;;", "02/02/2024;2,5;Bia", "Outro;;", "03/02/2024;7;Total geral"]
    path = tmp_path / "s.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    sheet = files.read_sample(spark, str(path))
    got = {r["header"]: (r["type"], r["align"], r["width_pct"]) for r in layout.column_profile(sheet).collect()}
    assert got == {"Data": ("date", "center", 33), "Valor": ("number", "right", 33), "Nome": ("text", "left", 33)}
    flags = layout.flags(sheet.withColumn("pos", F.monotonically_increasing_id()), "pos", ["Data", "Valor", "Nome"]).first()
    assert tuple(flags) == ("portrait", True, True, 3, 5)
    assert [layout.sniff_delimiter(x) for x in ("a,b;c", "a\tb", "a;b", "a")] == [",", "\t", ";", ","]


def test_golden_and_metrics(spark, tmp_path):
    lines = [
        "# comment", "", json.dumps({"query": "one", "top_k": 99, "expected_chunk_ids": ["a"]}),
        json.dumps({"query": "two", "domain": "LSP", "id": "own", "expected_signals": ["X "], "priority": "HIGH"}),
        json.dumps({"query": " "}), json.dumps({"query": "no", "domain": "web"}), json.dumps({"query": "three"}),
        json.dumps({"query": "four", "expected_source_urls": ["/P"], "filters": {"context": "c"}}),
    ]
    path = tmp_path / "g.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    g = files.read_golden(spark, str(path))
    rows = {r["query_id"]: r for r in g.collect()}
    assert set(rows) == {"q1", "own", "q3", "q4"}
    assert rows["q1"]["top_k"] == 30 and rows["own"]["priority"] == "high" and rows["q4"]["context"] == "c"
    ranked = spark.createDataFrame(
        [("q1", 1, "b", "u", "t"), ("q1", 4, "a", "u", "t"), ("own", 1, "c", "u", "has x here"), ("q3", 1, "a", "u", "t"), ("q4", 11, "d", "http://p", "t")],
        "query_id string, rank int, chunk_id string, source_url string, text string")
    hits = ev.first_hits(g, ranked)
    assert {r["query_id"]: r["first_hit"] for r in hits.collect()} == {"q1": 4, "own": 1, "q3": -1, "q4": -1}
    m = {r["domain"]: r for r in ev.metrics_by_domain(hits).collect()}
    assert (m["docs"]["evaluated"], m["docs"]["recall_at_5"], m["docs"]["mrr_at_10"]) == (2, 0.5, 0.125)
    assert m["overall"]["recall_at_3"] == pytest.approx(1 / 3)
    assert {r["query_id"] for r in ev.misses(hits).collect()} == {"q3", "q4"}
    assert "| overall | 4 | 3 |" in sinks.eval_markdown(ev.metrics_by_domain(hits))


def test_golden_queries_of_several_files(spark, tmp_path):
    """Numbered in path order, though Spark reads the larger file, named last, before the other; and across blocks."""
    small = [json.dumps({"query": f"a{i}"}) for i in range(5)]
    large = [json.dumps({"query": f"b{i}", "expected_signals": ["x" * 200]}) for i in range(400)]
    for name, lines in (("1.jsonl", small), ("2.jsonl", large)):
        (tmp_path / name).write_text("# head\n\n" + "\n".join(lines) + "\n", encoding="utf-8")
    want = [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(400)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in (before, "16384"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            for path in (str(tmp_path), [str(tmp_path / "2.jsonl"), str(tmp_path / "1.jsonl")]):
                got = {int(r["query_id"][1:]): r["query"] for r in files.read_golden(spark, path).collect()}
                assert [got[i] for i in sorted(got)] == want and sorted(got) == list(range(1, 406))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_percentiles(spark):
    values = [5.0] * 30 + [float(i) for i in range(70)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = ev.percentiles(df, "v", [0, 50, 95, 100]).first()
    s = sorted(values)
    assert tuple(got) == tuple(s[min(99, p * 100 // 100)] for p in (0, 50, 95, 100))
    assert tuple(ev.percentiles(df.limit(0), "v", [50]).first()) == (0.0,)


def test_percentiles_with_an_outlier(spark, monkeypatch):
    """One value of 1e9 among 0 to 1, a value that half of the rows hold, NaN and infinite ones; sorted a few at a time."""
    rnd = random.Random(4)
    values = [rnd.random() for _ in range(3000)] + [0.25] * 3000 + [1e9, -1e300, float("inf"), float("inf")] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    s = sorted(v for v in values if v is not None)
    points = [0, 1, 25, 50, 75, 90, 99, 100]
    for most in (100_000, 40, 1):
        monkeypatch.setattr(ev, "SORTED_AT_ONCE", most)
        assert tuple(ev.percentiles(df, "v", points).first()) == tuple(s[min(len(s) - 1, p * len(s) // 100)] for p in points)
    whole = spark.range(5000).select((F.col("id") % 7).alias("v"))
    assert tuple(ev.percentiles(whole, "v", [0, 50, 100]).first()) == (0, 3, 6)


def test_golden_synthesis(spark):
    rows = [("docs", f"c{i}", "ctx" if i % 2 else None, "Prod", f"u{i // 3}", f"Título {i}", "A > Tópico Final", "configuração detalhada " * 20) for i in range(30)]
    df = spark.createDataFrame(rows, "domain string, chunk_id string, context string, product string, source_url string, title string, heading_path string, text string")
    out = gold.docs_questions(df, 8).orderBy("id").collect()
    assert len(out) == 8 and len({r["expected_source_urls"][0] for r in out}) == 8
    assert out[0]["id"] == "docs-auto-001" and out[0]["query"] == "Como configurar Tópico Final no Prod?"
    assert out[0]["expected_signals_any"] == ["topico", "final", "titulo"]
    assert [r["priority"] for r in out] == ["high"] * 5 + ["normal"] * 3


def test_rule_corpus(spark):
    src = "@ Main title @\n" + "\n".join(f"line {i} {'needle' if i in (3, 5, 30) else ''}" for i in range(40))
    df = spark.createDataFrame([("FPRG001.rule", src), ("CSRG002.rule", "/*\n * ------\n * Second title\n */\ncancel(2); needle"), ("XX3.rule", "Needle EnviaEmail(")], "file string, source string")
    idx = corpus.index(df)
    titles = {r["file"]: (r["title"], r["module"], r["patterns"]) for r in idx.collect()}
    assert titles == {"FPRG001.rule": ("Main title", "FPRG", []), "CSRG002.rule": ("Second title", "CSRG", ["calculation"]), "XX3.rule": ("XX3", "XX", ["email"])}
    found = {r["file"]: r for r in corpus.search(idx, "NEEDLE").collect()}
    assert len(found) == 3 and not found["FPRG001.rule"]["full_source"]
    text = found["FPRG001.rule"]["context"]
    assert found["FPRG001.rule"]["match_count"] == 3 and text.count(">>>") == 2 and "    ...\n" in text
    few = corpus.search(idx, "needle", pattern="email").collect()
    assert len(few) == 1 and few[0]["context"] == "Needle EnviaEmail("


def test_scalar_edges(spark):
    df = spark.createDataFrame([(None, "", 2.345, 30, 2, 2023)], "a string, b string, n double, d int, m int, y int")
    got = df.select(
        fn.is_empty(F.col("a")), fn.is_empty(F.col("b")), fn.concat(F.col("a"), F.lit("x")), fn.rounded(F.col("n"), 2),
        fn.make_date(F.col("d"), F.col("m"), F.col("y")), fn.list_count(F.col("b"), ";"), fn.days_in_month(F.col("m"), F.col("y")),
        fn.list_item(F.lit("a;b"), ";", 2), fn.masked_number(F.lit(12345.678), 4, 1),
    ).first()
    assert tuple(got) == (1, 1, "x", 2.35, None, 0, 28, "b", "12,345.7")


def test_source_side_helpers(spark, tmp_path):
    from corpusops.operators import ingest

    rows = [("lsp", f"c{i}", f"src/my_file-{i}.prg", "mod" if i % 2 else None, "Rot" if i == 1 else None, "palavra chave " * 20) for i in range(4)]
    df = spark.createDataFrame(rows, "domain string, chunk_id string, file_path string, module string, routine_name string, text string")
    out = {r["expected_file_paths"][0]: r["query"] for r in gold.source_questions(df, 10).collect()}
    assert out["src/my_file-1.prg"] == "No LSP, o que faz Rot no modulo mod?"
    assert out["src/my_file-2.prg"] == "No LSP, o que faz my file 2?" and len(out) == 4
    one = df.filter("chunk_id = 'c1'").selectExpr(
        "*", "3 AS line_start", "9 AS line_end", "'' AS routine_signature", "CAST(NULL AS STRING) AS context", "'p' AS product", "'' AS version")
    text = one.select(ingest.source_embedding_input()).first()[0]
    assert text.split("\n")[:6] == ["domain: lsp", "module: mod", "routine: Rot", "file_path: src/my_file-1.prg", "line_start: 3", "line_end: 9"]
    assert text.split("\n")[6:8] == ["product: p", "content:"]
    path = tmp_path / "d.txt"
    path.write_text("a | b | c | d\n---|---|---|---\n(3 rows)\nx|y\n", encoding="utf-8")
    assert [r["cells"] for r in files.read_dump(spark, str(path)).collect()] == [["a", "b", "c", "d"]]
    parsed = spark.createDataFrame([((True,),), ((False,),), (None,)], "_stats struct<parseComplete:boolean>")
    assert tuple(models.parse_outcomes(parsed).first()) == (1, 1, 1)


def test_running_total_keeps_null_keys(spark):
    rows = [(None, 1, 1), ("a", None, 2), ("a", 1, 3), ("a", 1, 4)]
    df = spark.createDataFrame(rows, "k string, b int, v int")
    got = bands.running_total(df, ["k"], ["v"], F.col("v"), F.col("b")).collect()
    assert sorted((r.k or "", r.v, r.running) for r in got) == [("", 1, 1), ("a", 2, 2), ("a", 3, 5), ("a", 4, 9)]


def test_last_field_line_wins(spark):
    df = spark.createDataFrame([(1, "R1|F|first|2|4"), (2, "R1|F|second|1|9")], "pos int, value string")
    assert [(r["type"], r["size"], r["description"]) for r in modelkb.field_dictionary(df).collect()] == [("alpha", 9, "second")]


def test_fold_takes_off_any_accent(spark):
    df = spark.createDataFrame([("Škoda Função ÇÃO",)], "t string")
    assert df.select(gold.fold(F.col("t"))).first()[0] == "skoda funcao cao"


def test_details_of_another_key_are_met_through_links(spark):
    """The rows are those of the join by the master's own key, repeated and null keys among them; they are not shuffled."""
    master = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (3, "c"), (None, "n")], "k int, name string")
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, None), (None, 10)], "k int, area int")
    detail = spark.createDataFrame([(10, "x"), (10, "y"), (20, "z"), (None, "w")], "area int, item string")
    plain = bands.multi_detail(master, "k", {"items": links.join(detail, "area").drop("area")})
    linked = bands.multi_detail(master, "k", {"items": F.broadcast(detail)}, {"items": (links, "area")})
    assert sorted(map(str, linked.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) and plain.count() == 8
    tree = linked._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in tree and "area" in tree.split("REPARTITION_BY_NUM")[0]  # the detail is met after the last shuffle


def test_details_of_groups_of_masters(spark, monkeypatch, tmp_path):
    """Groups lose and repeat no row, and a detail row is written beside the same masters in turn, in under a byte a row."""
    master = spark.range(4000).selectExpr("id AS k", "concat('Customer#', lpad(id, 9, '0')) AS name")
    links = spark.range(4000).selectExpr("id AS k", "CAST(id % 25 AS INT) AS area")
    detail = spark.range(10000).selectExpr("CAST(id % 25 AS INT) AS area", "concat('Supplier#', lpad(id, 9, '0')) AS item")
    linked = bands.multi_detail(master, "k", {"items": detail}, {"items": (links, "area")})
    linked.write.parquet(f"{tmp_path}/linked")
    assert linked.count() == linked.distinct().count() == 1600000
    assert sum(f.stat().st_size for f in (tmp_path / "linked").glob("*.parquet")) < 1600000
    monkeypatch.setattr(bands, "GROUP", 3)
    some, twice = master.where("k < 20"), links.where("k < 20").unionAll(links.where("k < 4"))
    few = bands.multi_detail(some, "k", {"items": detail.where("item < 'Supplier#000000040'")}, {"items": (twice, "area")})
    want = [(k, i) for k in [*range(20), *range(4)] for i in range(40) if i % 25 == k % 25]
    assert sorted((r.k, int(r.item[-9:])) for r in few.collect()) == sorted(want) and few.columns == ["k", "name", "item", "band"]


def test_fold_is_the_canonical_decomposition_without_python(spark):
    """Every character alone, and marks in a row behind a letter, as the decomposition says."""
    def plain(t: str) -> str:
        low = "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) < 0x370)
        return re.sub("[^a-z0-9_./-]+", " ", low).strip(" ")

    texts = ["ạ́b", "é֑x", "ệ ǖ", "ä́b", None, "", "plain.text/9"]
    texts += [f"x{chr(c)}y" for c in [*range(0x20, 0xD800), *range(0xE000, 0x11000), *range(0x1D100, 0x1D800), *range(0x2F800, 0x2FA20)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", F.lower("t").alias("low"), gold.fold(F.col("t")).alias("got"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r for r in df.collect() if r["got"] != (None if r["t"] is None else plain(r["low"]))] == []


def test_diff_ships_what_it_compares(spark):
    """Null bands and children, children of another length, and a field that is not compared."""
    child = "struct<type:string,name:string,caption:string,table:string,field:string,tableField:string>"
    schema = f"filename string, caption string, sections map<string,string>, bands array<struct<name:string,bandType:string,tag:int,tableList:array<string>,children:array<{child}>>>"
    c = lambda name, other=None: ("T", name, None, None, None, other)
    band = lambda *children: ("b", "D", 1, ["t"], list(children))
    old = [("m", "x", {"s": " long "}, [band(c("a"), None, c("z", "1")), None, band(c("q"))])]
    new = [("m", "y", {"s": "long", "t": "new"}, [band(c("b\n\"é"), c("n"), c("z", "2"), c("more")), band(c("k")), None])]
    found = models.diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert "tableField" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert sorted(tuple(r) for r in found.collect() if r["path"].startswith(("caption", "sections", "bands[0]"))) == [
        ("m", "bands[0].children.length", "3", "4"), ("m", "bands[0].children[0].name", "a", "b\n\"é"),
        ("m", "bands[0].children[1].name", None, "n"), ("m", "bands[0].children[1].type", None, "T"), ("m", "caption", "x", "y")]
    rest = sorted(r["path"] for r in found.collect() if r["path"].startswith(("bands[1]", "bands[2]")))
    assert rest == [f"bands[{i}].{k}" for i in (1, 2) for k in ("bandType", "children.length", "name", "tag")]
