"""Ingest: JSON lines, cleaning, cutting, tags, merging and the file stream."""

import hashlib
import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusops.operators import buckets, chunking, embeddings, ingest, lexical, merge, postings, reindex, tagging
from corpusops.operators.chunking import overlap_pieces
from corpusops.operators.hybrid import Filters, hybrid_search
from corpusops.plans import ingest as plans
from corpusops.plans.ingest import doc_lines
from corpusops.sources import files
from corpusops.streaming.incremental import merge_batch, run_available

LONG = "A sentence that is long enough to be kept by the cleaning step, and some more."


def test_json_lines(spark, tmp_path):
    lines = [
        json.dumps({"text": LONG, "source_url": "u1", "title": "T", "content_hash": ""}),
        "",
        '{"text": "broken',
        json.dumps({"text": "short", "source_url": "u2"}),
        json.dumps({"text": LONG + "\r\n\n\n\n  end  ", "source_url": "u3", "product": ""}),
        json.dumps({"text": LONG, "source_url": "u4", "chunk_id": "given"}),
    ]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    status = ingest.doc_status(files.read_doc_lines(spark, [str(path)]))
    stats = ingest.run_stats(status, "docs").first()
    assert (stats["scanned"], stats["indexed"], stats["skipped"], stats["errors"]) == (5, 3, 1, 1)
    chunks = ingest.doc_chunks(status)
    kept = {r["source_url"]: r for r in merge.keep_last(chunks, "input_pos").collect()}
    assert set(kept) == {"u3", "u4"}  # u1 and u4 hold the same text, the later one wins
    assert kept["u4"]["chunk_id"] == "given" and kept["u3"]["product"] is None
    assert kept["u3"]["text"] == LONG + "\n\n end"
    assert json.loads(kept["u3"]["metadata"])["last_modified"] is None
    try:
        files.read_doc_lines(spark, [str(path), str(tmp_path / "none.jsonl")])
        raise AssertionError("a missing file must fail")
    except FileNotFoundError as e:
        assert "none.jsonl" in str(e)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc \n", max_size=900), st.integers(10, 120), st.integers(0, 40))
def testoverlap_pieces_cover_the_text(text, size, overlap):
    text = text.strip()
    pieces = overlap_pieces(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    at = 0
    for p in pieces:
        found = text.find(p, max(0, at - size - overlap))
        assert found >= 0
        assert text[at:found].strip() == "" or found <= at
        at = max(at, found + len(p))
    assert text[at:].strip() == ""


def test_line_spans(spark):
    pieces = ["a\nb\nc", "d", "\n".join("x" * 1 for _ in range(20)), "e\nf"]
    df = spark.createDataFrame([(pieces,)], "p array<string>")
    got = [tuple(r) for r in df.select(chunking.line_spans(F.col("p"), F.lit(5), F.lit(18))).first()[0]]
    at, want = 5, []
    for p in pieces:
        end = min(18, at + p.count("\n"))
        want.append((at, end))
        at = max(end - 6, at + 1)
    assert got == want


def test_source_chunks(spark):
    two = "header\nFunction Alpha\n" + "body line with words\n" * 200 + "sub beta.x\nend"
    plain = "\n".join(f"line {i}" for i in range(200))
    df = spark.createDataFrame([("two", two), ("plain", plain)], "file string, text string")
    out = chunking.source_chunks(df, ["file"]).collect()
    two_rows = sorted((r for r in out if r["file"] == "two"), key=lambda r: (r["block_no"], r["piece_no"]))
    assert {r["routine_name"] for r in two_rows} == {"Alpha", "beta.x"}
    assert all(r["text"].lower().startswith(r["routine_signature"].lower()) for r in two_rows)
    assert not any("header" in r["text"] for r in two_rows)
    assert two_rows[0]["line_start"] == 2
    blocks = sorted((r["line_start"], r["line_end"]) for r in out if r["file"] == "plain")
    assert blocks == [(1, 80), (69, 148), (137, 200)]


def test_source_tree(spark, tmp_path):
    root, extra = tmp_path / "src", tmp_path / "more"
    for path, data in {
        root / "mod" / "a.PRG": LONG.encode(), root / "b.txt": b"with\x00nul", root / "c.bin": b"data",
        root / "node_modules" / "d.txt": LONG.encode(), extra / "e.lsp": b"bad \xff byte",
    }.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_sources(spark, [str(root), str(extra)]).collect()}
    assert set(rows) == {"a.PRG", "b.txt", "c.bin", "e.lsp"}
    assert {k for k, r in rows.items() if r["status"] == "ready"} == {"a.PRG", "e.lsp"}
    assert rows["e.lsp"]["text"] == "bad � byte"
    nested = files.read_tree(spark, [str(root), str(root / "mod")]).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["base"]) for r in nested) == [
        (n, str(root)) for n in ("a.PRG", "b.txt", "c.bin")]
    df = spark.createDataFrame([(r["path"], r["base"]) for r in rows.values()], "path string, base string")
    rel = tagging.relative_path(F.col("path"), F.col("base"), F.lit(str(root)))
    got = {tuple(r) for r in df.select(rel, tagging.module_name(rel), tagging.routine_from_file(rel)).collect()}
    assert got == {("mod/a.PRG", "mod", "a"), ("b.txt", "root", "b"), ("c.bin", "root", "c"), ("more/e.lsp", "more", "e")}


def test_tag_rules_last_match_wins(spark):
    rules = [tagging.TagRule("MOD", module="m1", context="c1"), tagging.TagRule("a.prg", module="m2", routine_name="r2"),
             tagging.TagRule("zzz", module="m3")]
    df = spark.createDataFrame([("/x/mod/a.prg", "mod/a.prg")], "p string, r string")
    tags = tagging.apply_rules(F.col("p"), F.col("r"), rules, F.lit("mod"), F.lit("a"))
    got = df.select(*[c.alias(n) for n, c in tags.items()]).first().asDict()
    assert got == {"module": "m2", "routine_name": "r2", "heading_path": "a", "context": "c1", "product": None, "version": None}


def test_empty_seen_set_empties_the_domain(spark):
    t = spark.createDataFrame([("docs", "h1"), ("lsp", "h2")], "domain string, content_hash string")
    assert [tuple(r) for r in merge.drop_stale(t, t.limit(0), "docs").collect()] == [("lsp", "h2")]


def test_stream_takes_new_files_and_replays(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inbox, root, progress = (str(tmp_path / d) for d in ("in", "table", "progress"))
    docs.filter("doc_id < 100").write.parquet(inbox)
    stream = lambda: doc_lines(spark.readStream.schema(docs.schema).parquet(inbox))
    first = run_available(spark, stream(), root, progress, "2024-01-01 00:00:00").count()
    docs.filter("doc_id >= 50").write.mode("append").parquet(inbox)
    second = run_available(spark, stream(), root, progress, "2024-02-01 00:00:00")
    whole = ingest.doc_chunks(ingest.doc_status(doc_lines(docs))).select("content_hash").distinct().count()
    assert first < whole and second.count() == whole
    stamps = second.groupBy("created_at", "updated_at").count().collect()
    assert {(str(r[0])[:10], str(r[1])[:10]) for r in stamps} == {
        ("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-02-01"), ("2024-02-01", "2024-02-01")}
    once = second.filter("created_at = updated_at").count()
    # the same batch once more leaves the same table
    merge_batch(spark, doc_lines(docs.filter("doc_id >= 50")), root, "2024-02-01 00:00:00")
    again = buckets.read(spark, root)
    assert again.count() == whole and again.filter("created_at = updated_at").count() == once


def test_small_batch_leaves_other_buckets_alone(spark, sf, tmp_path):
    docs, root = spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "table")
    files_of = lambda: {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
    assert merge_batch(spark, doc_lines(docs.limit(0)), root, "2024-01-01 00:00:00") == [] and buckets.read(spark, root) is None
    merge_batch(spark, doc_lines(docs), root, "2024-01-01 00:00:00", n_buckets=16)
    before, rows = files_of(), {r.content_hash: r for r in buckets.read(spark, root).collect()}
    one = doc_lines(docs.filter("length(text) > 300").orderBy("doc_id").limit(1))
    (written,) = merge_batch(spark, one, root, "2024-03-01 00:00:00", n_buckets=99)  # a table keeps its number of buckets
    after = files_of()
    part = f"domain={written[0]}/bucket={written[1]}/"
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if part in f} and len(before) > 4
    assert {f for f in after if f not in before} == {f for f in after if part in f}
    now = {r.content_hash: r for r in buckets.read(spark, root).collect()}
    changed = [h for h in now if now[h].updated_at != rows[h].updated_at]
    assert now.keys() == rows.keys() and len(changed) == 1 and str(now[changed[0]].updated_at)[:10] == "2024-03-01"
    assert all(now[h].created_at == rows[h].created_at for h in now)


def test_search_over_the_streamed_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inbox, root = str(tmp_path / "in"), str(tmp_path / "table")
    docs.write.parquet(inbox)
    table = run_available(spark, doc_lines(spark.readStream.schema(docs.schema).parquet(inbox)), root, str(tmp_path / "progress"), "2024-01-01 00:00:00")
    wanted = table.orderBy("chunk_id").first()
    assert table.filter("embedding is null").count() == 0
    found = hybrid_search(table, " ".join(wanted.text.split()[:3]), list(wanted.embedding), "docs", Filters(), 5).collect()
    assert len(found) == 5 and found[0].chunk_id == wanted.chunk_id and found[0].vector_score == pytest.approx(1.0)


def test_provider_embeds_a_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    merge_batch(spark, doc_lines(docs), str(tmp_path / "a"), "2024-01-01 00:00:00")
    merge_batch(spark, doc_lines(docs), str(tmp_path / "b"), "2024-01-01 00:00:00", embeddings.hash_provider())
    a, b = ({r.chunk_id: r.embedding for r in buckets.read(spark, str(tmp_path / d)).collect()} for d in "ab")
    assert a == b and len(a) > 10


def test_later_file_wins(spark, tmp_path):
    text = "the same text in two files, long enough to be kept as a document chunk"
    (tmp_path / "a.jsonl").write_text(json.dumps({"chunk_id": "a", "text": text}) + "\n")
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"chunk_id": f"b{i}", "text": f"{i} " + text * 50}) + "\n" for i in range(300)) + json.dumps({"chunk_id": "b", "text": text}) + "\n")
    for first, last in (("a", "b"), ("b", "a")):
        lines = files.read_doc_lines(spark, [str(tmp_path / f"{first}.jsonl"), str(tmp_path / f"{last}.jsonl")])
        assert lines.filter(F.col("text") == text).orderBy(F.desc("input_pos")).first().chunk_id == last


def test_reindex_writes_both_domains_and_keeps_errors_apart(spark, tmp_path):
    root, src, docs = str(tmp_path / "table"), tmp_path / "src", tmp_path / "a.jsonl"
    texts = [LONG, LONG, "short", LONG + " Second."]
    docs.write_text("\n".join([json.dumps({"text": t, "title": f"T{i}", "source_url": f"u{i}"}) for i, t in enumerate(texts)] + ["{bad"]))
    (src / "hr").mkdir(parents=True)
    code = "Function Pay(x)\n" + "line of the routine, with several words in it\n" * 60
    for name, text in {"hr/pay.prg": code, "notes.txt": LONG, "tiny.txt": "x", "old/skip.bin": LONG}.items():
        (src / name).parent.mkdir(exist_ok=True)
        (src / name).write_text(text)
    rules = [tagging.TagRule("hr/", product="payroll")]

    def run(doc_file, folder, now):
        return reindex.reindex_all({
            "docs": lambda: reindex.index_documents(files.read_doc_lines(spark, [str(doc_file)]), root, True, now),
            "lsp": lambda: reindex.index_sources(files.read_sources(spark, [str(folder)]), root, str(folder), rules, True, now),
        })

    first = run(docs, src, "2024-01-01 00:00:00")
    read = lambda: [r.asDict() for d in ("docs", "lsp") for r in reindex.read_chunks(spark, root, d).collect()]
    rows = read()
    pieces = chunking.overlap_pieces(code.strip(), 1400, 220)
    assert first.errors == [] and first.runs == [
        {"domain": "docs", "scanned": 5, "indexed": 3, "skipped": 1, "errors": 1},
        {"domain": "lsp", "scanned": 4, "indexed": len(pieces) + 1, "skipped": 2, "errors": 0}]
    assert sorted(r["source_url"] for r in rows if r["domain"] == "docs") == ["u1", "u3"]
    assert all(len(r["embedding"]) == 1024 and r["created_at"] == r["updated_at"] for r in rows)

    sha1 = lambda s: hashlib.sha1(s.encode()).hexdigest()
    pay = {json.loads(r["metadata"])["line_start"]: r for r in rows if r["file_path"] == "hr/pay.prg"}
    key, at = f"hr/pay.prg::{src}/hr/pay.prg", 1
    for i, piece in enumerate(pieces):
        end = min(62, at + piece.count("\n"))
        text = piece if "function pay(x)" in piece.lower() else f"Function Pay(x)\n{piece}"
        hash_, r = sha1(f"{key}:{at}:{end}:{text}"), pay.pop(at)
        assert (r["text"], r["content_hash"], r["chunk_id"]) == (text, hash_, sha1(f"lsp::{key}::{i}::{hash_}")[:32])
        assert (r["module"], r["routine_name"], r["heading_path"], r["product"]) == ("hr", "Pay", "Pay", "payroll")
        said = (f"domain: lsp\nmodule: hr\nroutine: Pay\nfile_path: hr/pay.prg\nline_start: {at}\nline_end: {end}\n"
                f"routine_signature: Function Pay(x)\nproduct: payroll\ncontent:\n{text}")
        digest = hashlib.sha256(said.encode()).digest()
        assert r["embedding"][:32] == [(b - 128) / 128 for b in digest]
        at = max(end - 6, at + 1)
    assert not pay

    # a missing document file is that run's error alone; the other run drops what it no longer sees
    (src / "hr" / "pay.prg").write_text("no routine here, only a line that is long enough to be kept as a chunk")
    second = run(tmp_path / "none.jsonl", src, "2024-02-01 00:00:00")
    assert [r["domain"] for r in second.runs] == ["lsp"] and [e["domain"] for e in second.errors] == ["docs"]
    assert "none.jsonl" in second.errors[0]["error"]
    later = read()
    assert sorted((r["domain"], r["source_url"] or r["file_path"], str(r["created_at"])[:7], str(r["updated_at"])[:7]) for r in later) == [
        ("docs", "u1", "2024-01", "2024-01"), ("docs", "u3", "2024-01", "2024-01"),
        ("lsp", "hr/pay.prg", "2024-02", "2024-02"), ("lsp", "notes.txt", "2024-01", "2024-02")]

    # a run that is not full keeps what it has not seen
    more = tmp_path / "b.jsonl"
    more.write_text(json.dumps({"text": LONG, "source_url": "u9"}))
    reindex.index_documents(files.read_doc_lines(spark, [str(more)]), root, False, "2024-03-01 00:00:00")
    assert sorted((r["source_url"], str(r["created_at"])[:7], str(r["updated_at"])[:7]) for r in read() if r["domain"] == "docs") == [
        ("u3", "2024-01", "2024-01"), ("u9", "2024-01", "2024-03")]


def test_word_index_follows_the_version(spark, tmp_path):
    """The index of a version is not used for the next one; text search through it equals that over the texts."""
    root, path = str(tmp_path / "kb"), tmp_path / "d.jsonl"
    asked = spark.createDataFrame([("a", "text number"), ("b", '"number 7"')], "query_id string, text string")
    assert reindex.write_words(spark, root, "docs") is None and reindex.read_words(spark, root, "docs") is None
    for n in (5, 9):
        path.write_text("\n".join(json.dumps({"source_url": f"u{i}", "text": f"text number {i} " + "x" * 80}) for i in range(n)), encoding="utf-8")
        reindex.index_documents(files.read_doc_lines(spark, [str(path)]), root, True, "2024-01-01 00:00:00")
        assert reindex.read_words(spark, root, "docs") is None
        reindex.write_words(spark, root, "docs")
        chunks = reindex.read_chunks(spark, root, "docs")
        got = {tuple(r) for r in postings.index_matches(reindex.read_words(spark, root, "docs"), asked).collect()}
        assert got == {tuple(r) for r in lexical.text_matches(chunks, asked).collect()}
        assert len(got) == n + (n > 7)


def test_reindex_query_runs_both_and_survives_one(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    with pytest.warns(UserWarning, match="lsp failed"):
        got = plans.ing_reindex_all(spark, str(tmp_path)).collect()
    assert [r["domain"] for r in got] == ["docs"] and got[0]["indexed"] > 0
