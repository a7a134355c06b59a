"""Operators that compare texts with each other, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup, spans
from tessera.llm.components import components
from tessera.llm.shingles import shingle_sets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, sf_dir, words):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], words, 80)
    got = neardup.near_duplicates(docs, words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicate_edges(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [(100 + k, " ".join([*base[:k], *[f"x{i}" for i in range(k)], *base[k:]][:60])) for k in range(0, 12, 1)]
    many = [(1000 + k, " ".join([*base, "tail", f"t{k}"])) for k in range(150)]
    long = "alpha beta " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "WORD"), (6, "other"), (7, long), (8, long + "end"), (8, long + "end"), *chain, *many]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("mine")).withColumn("kept", F.lit("mine"))
    got = neardup.near_duplicates(docs, 2).collect()
    want = brute(dict(rows).items(), 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    one = neardup.keep_first(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), 2)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert one.where("doc_id is null").count() == 1
    assert neardup.near_duplicates(docs.limit(0), 2).count() == 0


def test_different_texts_under_one_doc_id(spark):
    """Each is a document of its own; a repeated row leaves one."""
    other = "quite other words here"
    rows = [(1, "alpha beta gamma"), (1, other), (1, other), (2, "alpha beta gamma"), (3, ""), (3, ""), (3, None), (None, other), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_near_id", F.lit("mine")).withColumn("_near_key", F.lit("mine"))
    got = neardup.keep_first(docs, 2)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in got.collect()) == sorted([(1, "alpha beta gamma", False), (1, other, False), (3, "", False), (3, "", True), (0, other, False), (0, other, False)])
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs, 2).collect()} == {(1, 1), (2, 1), (3, 3), (None, None)}


def test_long_texts_have_the_same_shingles(spark, monkeypatch):
    text = " ".join(random.Random(3).choices(["a", "Bee", "sea", "dé", "\n", "x" * 90], k=3000))
    want = {h for h in next(shingle_sets([text], 5)).tolist()}
    monkeypatch.setattr("tessera.llm.shingles._STEP", 500)
    assert {h for h in next(shingle_sets([text], 5)).tolist()} == want and len(want) == len(shingles(text, 5))


def test_pruning_keeps_what_may_be_alike():
    for n in range(neardup.BATCH, neardup.HASHES + 1, neardup.BATCH):
        least = neardup.least_matches(n, 80)
        assert 0.3 * n < least < 0.8 * n  # well under what a pair at the threshold shows


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (53, 52), (51, 52), (60, 60)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links, 30).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50, 52: 50, 53: 50}
    assert components(links.limit(0), 0).count() == 0


def brute_spans(rows):
    """doc_id -> (units removed, text left), by tuples of words."""
    first, units = {}, {}
    for d, t in sorted(rows):
        u, at, words = [], "", []
        for token in re.findall(r"\s*\S+\s*|\s+", t or ""):
            at, words = at + token, [*words, token.strip().lower()]
            code = int.from_bytes(hashlib.blake2b(words[-1].encode(), digest_size=8).digest(), "little") >> 1
            if "\n" in token or words[-1][-1:] in {".", "!", "?"} or code % spans.CUT == 0:
                u.append((at, words))
                at, words = "", []
        u += [(at, words)] if words else []
        runs = {}
        for i in range(len(u)):
            for j in range(i + spans.RUN, len(u) + 1):
                run = [w for _, words in u[i:j] for w in words]
                if len(run) >= spans.LEAST:
                    runs[i, j] = tuple(run)
                    break
        units[d] = u, runs
        for (i, _), run in sorted(runs.items()):
            first.setdefault(run, (d, i))
    out = {}
    for d, (u, runs) in units.items():
        gone = {k for (i, j), run in runs.items() if first[run] != (d, i) for k in range(i, j)}
        out[d] = len(gone), "".join(x for i, (x, _) in enumerate(u) if i not in gone)
    return out


def test_repeated_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in spans.remove_repeats(docs).collect()}
    assert got == brute_spans([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeated_span_edges(spark):
    passage = "One sentence of several words stands here. Another one follows it with more words. The third one closes the passage for good and all of its readers."
    rows = [(1, f"Head of one. {passage} Tail of one."), (2, f"Start two and then {passage} End two."), (3, passage), (4, None), (5, ""), (6, "short."), (7, "a b c d e f. " * 3000), (8, f"{passage}\n{passage}"), (9, " \n\t"), (10, "\n\n" + passage.upper().replace(" ", "  "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("starts", F.lit("mine")).withColumn("places", F.lit("mine"))
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in spans.remove_repeats(docs.unionByName(docs.where("doc_id = 4"))).collect()}
    assert got == brute_spans(rows)
    assert "Another one" in got[1][1] and "Another one" not in got[2][1] and got[3][1] == "" and got[6][0] == 0 and got[10][1] == ""
    nameless = spark.createDataFrame([(None, passage), (5, passage), (None, "other")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in spans.remove_repeats(nameless).collect()) == [(0, ""), (0, "other"), (5, passage)]
    assert spans.remove_repeats(docs.limit(0)).count() == 0
    # Nothing goes of which no other place has a copy, whatever ids rows share.
    other = passage.replace("One", "Some").replace("Another", "Any").replace("third", "last")
    for nameless in (None, 6):
        rows = [(5, passage), (nameless, passage), (nameless, other), (7, passage), (7, other), (7, other)]
        left = spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        kept = Counter((r["doc_id"], r["text"]) for r in left)
        assert kept[5, passage] == 1 and sum(n for (_, t), n in kept.items() if t == passage) == 1
        assert kept == ({(5, passage): 1, (6, ""): 1, (6, other): 1, (7, ""): 3} if nameless else {(5, passage): 1, (None, ""): 2, (7, ""): 1, (7, other): 2})


def test_whole_sentences(spark):
    """Without cuts, only whole sentences are found and removed."""
    three = "One sentence of several words stands here. Another one follows it with more words. The third one closes the passage for good."
    rows = [(1, f"Head one. {three} Tail one."), (2, f"Half of {three} Tail two."), (3, f"Whole head. {three} End.")]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), cuts=False).collect()}
    assert got == {1: (0, rows[0][1]), 2: (0, rows[1][1]), 3: (3, "Whole head. End.")}


def test_repeated_passages_are_found_inside_sentences():
    """A passage of 55 words without a sentence end, at any offset within other sentences."""
    word = random.Random(4)
    make = lambda n: ["".join(word.choices("abcdefghij", k=6)) for _ in range(n)]
    caught = []
    for k in range(200):
        passage = make(55)
        places = [{h for h in spans.runs_of(*spans.cut(" ".join([*make(n), *passage, *make(9)]))[1:])[0].tolist()} for n in (3, 3 + k % 20)]
        caught.append(bool(places[0] & places[1]))
    assert sum(caught) >= 195


def brute_words(rows):
    """doc_id -> text left, with windows, by tuples of words. Rows have different doc_ids."""
    first, places = {}, {}
    for d, t in sorted(rows):
        tokens, _, bounds = spans.cut(t)
        words, bounds, found = [x.strip().lower() for x in tokens], bounds.tolist(), []
        for i in range(len(bounds)):
            j = next((j for j in range(i + spans.RUN, len(bounds)) if bounds[j] - bounds[i] >= spans.LEAST), None)
            found += [(0, bounds[i], bounds[j])] if j else []
        runs = [(a, b) for _, a, b in found]
        found += [(1, a, a + 50) for a in range(len(words) - 49) if not any(a < x and y < a + 50 for x, y in runs)]
        places[d] = tokens, [(kind, tuple(words[a:b]), a, b) for kind, a, b in found]
        for kind, run, a, _ in places[d][1]:
            first.setdefault((kind, run), (d, a))
    out = {}
    for d, (tokens, found) in places.items():
        gone = {k for kind, run, a, b in found if first[kind, run] != (d, a) for k in range(a, b)}
        out[d] = "".join(x for k, x in enumerate(tokens) if k not in gone)
    return out


def test_repeated_windows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs, windows=True).collect()}
    assert got == brute_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    runs = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs).collect()}
    assert any(len(got[d]) < len(runs[d]) for d in got) and all(len(got[d]) <= len(runs[d]) for d in got)


def test_repeated_passages_are_found_whatever_their_cuts(spark):
    """Passages of 50 words without a sentence end, at any offset: all of random words, and such of words that never end a unit."""
    word = random.Random(4)
    make = lambda n: ["".join(word.choices("abcdefghij", k=6)) for _ in range(n)]
    hashes = lambda ws: set(spans.runs_of(*spans.cut(" ".join(ws))[1:], windows=True)[0].tolist())
    cutless = [w for w in make(900) if len(spans.cut(w + " x")[2]) == 2]
    for k in range(1000):
        passage = make(50) if k % 2 else word.choices(cutless, k=50)
        assert hashes([*make(3), *passage, *make(9)]) & hashes([*make(3 + k % 20), *passage, *make(k % 7)])
    one, two, passage = make(3), make(7), word.choices(cutless, k=60)
    docs = spark.createDataFrame([(1, " ".join([*one, *passage, "end"])), (2, " ".join([*two, *passage, *two]))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs, windows=True).collect()}
    assert got == {1: " ".join([*one, *passage, "end"]), 2: " ".join([*two, *two])}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from tessera.llm import quality, secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]
    at = docs
    seen = defaultdict(dict)
    for name, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame((out := stage(spark, at, sf_dir)).collect(), out.schema)
        seen[name] = {r["doc_id"]: r for r in at.collect()}
        assert name == "tokens" or at.columns == docs.columns
    assert set(seen["quality"]) == {r["doc_id"] for r in quality.score_quality(docs).where("kept").collect()}
    groups = brute([(i, r["text"]) for i, r in seen["quality"].items()], 5, 80)
    assert set(seen["near_duplicates"]) == {i for i, (_, c) in groups.items() if i == c}
    assert all(not secrets.find_spans(r["text"]) for r in seen["secrets"].values())
    assert set(seen["secrets"]) == set(seen["near_duplicates"]) and set(seen["mixing"]) <= set(seen["secrets"])
    assert {i: r["decoded_sha256"] for i, r in seen["tokens"].items()} == {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in seen["mixing"].items()}
    run = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in run.collect()} == set(seen["tokens"])


def test_pipeline_edges(spark, tmp_path):
    """Null, empty, long, repeated rows, ties, missing ids, clashing columns, an empty table; clean rows come through."""
    import corpus_pipeline

    prose = "The quiet river ran past the old mill while people of the town walked home along its banks in the evening light, talking of work and weather. "
    other = "A second text about gardens tells how seeds are sown in spring, watered through the summer, and how their fruit is gathered before the first frost. "
    rows = [(1, None, "en", "src0"), (2, "", "en", "src1"), (3, "word", None, None), (4, prose + other, "en", "src0"), (5, prose + other, "en", "src0"), (5, prose + other, "en", "src0"), (6, other, "de", "src1"), (None, other + "It stays.", "en", "src2")]
    rows += [(7, "\n".join(f"{other} {k} {prose}" for k in range(600)), "fr", "src1"), (8, "Notes for whoever opens the harbour office on Monday: the key hangs behind the map, the password = hunter2hunter2 is for the old clerk, and tea is kept in the tin by the window.", "en", "src3")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.withColumns({c: F.lit("mine") for c in ("blob", "spans", "node", "label", "leaf", "times", "key", "ids", "n_tokens")})
    folder = str(tmp_path)
    at = clash
    for name, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame((out := stage(spark, at, folder)).collect(), out.schema)
        if name != "tokens":
            assert at.columns == clash.columns and all(r["blob"] == "mine" for r in at.collect())
        if name == "near_duplicates":
            assert {r["doc_id"] for r in at.collect()} & {4, 5} == {4}
        if name == "secrets":
            assert "hunter2" not in "".join(r["text"] or "" for r in at.collect()) and any("[assign]" in (r["text"] or "") for r in at.collect())
    assert at.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and all(r["n_tokens"] > 0 for r in at.collect())
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_same_rows_as_sql(spark, sf_dir):
    from tessera.llm import registry
    from tests.oracle import compare, duck

    db = duck(sf_dir)
    for name, sql in registry.oracle_sql().items():
        assert compare(registry.queries()[name](spark, sf_dir), db, sql) is None
