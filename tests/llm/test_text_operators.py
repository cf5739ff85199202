"""License scans, quality rules, token counts and toxicity against brute force and edge rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventframe.llm import license_scan, quality_rules, queries, token_counts, toxicity

SF = "/root/testdata/sf0.001"
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "x " * 60_000), (6, "Licensed under CC BY-NC 4.0."), (7, "All rights reserved. all RIGHTS reserved"),
    (7, "All rights reserved. all RIGHTS reserved"), (None, "cc by cc by"), (9, "\x00nul\x00 and 　 wide 日本語"), (10, "a" * 100_000),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, None, "s", 5, 0.5, 1) for i, t in EDGES], "doc_id long, text string, lang string, source string, size int, score double, n_words int")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, edges):
        texts = Counter((r["doc_id"], brute_phrases(r["text"])) for r in table.select("doc_id", "text").collect())
        got = license_scan.license_scan(table, into="r").select("doc_id", "r.*").collect()
        assert Counter((r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got) == texts
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"), ("released under the terms of the MIT license", "mit"), ("released under some MIT license", ""),
        ("GNU General Public License, version 3", "gpl,gpl-3.0"), ("Copyright (c) 2020 Some One. All rights reserved.", "copyright-notice,reserved"),
        ("Copyright. All rights reserved.", "reserved"), ("licensed under cc by nc 4.0", "cc-by,cc-by-nc"), ("Licensed under the Apache License, Version 2.0", "apache-2.0"), ("", ""),
    ],
)
def test_templates(text, labels):
    assert license_scan.scan(text.encode())["labels"] == labels


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_licences_match_word_for_word():
    """Replaceable names may differ and optional regions be absent; no mandatory word may."""
    labels = lambda text: license_scan.scan(text.encode())["labels"].split(",")
    assert "mit" in labels(f"Some file. {MIT} And more.") and "mit" in labels(MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "Jane Roe"))
    assert "mit" not in labels(MIT.replace("publish, distribute", "publish")) and "mit" not in labels(MIT[:300] + " but no commercial use")
    words = license_scan.words_of(MIT.encode())
    automaton = next(a for label, a in license_scan.compiled() if label == "mit" and len(a.edges) > 100)
    free = {i for i, w in enumerate(words) if w == b"software"} | set(range(words.index(b"shall", 100), words.index(b"liable") + 1))
    for i in set(range(len(words))) - free:
        changed = [*words[:i], b"xyzzy", *words[i + 1 :]]
        assert automaton.found(changed, b" " + b" ".join(changed) + b" ") is None, words[i]


@pytest.mark.parametrize("label", ["isc", "bsd", "zlib"])
def test_templates_accept_their_own_wording(label):
    for template in license_scan.TEMPLATES[label]:
        for optional in (True, False):
            text = re.sub(r"\{\{\w+:(\d+)(?:-\d+)?\}\}", lambda m: " some" * int(m[1]), template)
            text = text.replace("[[", "").replace("]]", "") if optional else re.sub(r"\[\[.*?\]\]", "", text)
            assert label in license_scan.scan(text.encode())["labels"].split(",")


def test_automata_against_regular_expressions():
    rng = np.random.default_rng(1)
    template = "a [[b c]] {{v:0-2}} d [[e]] f"
    pattern = re.compile(r"(?:^| )a(?: b c)?(?: \w){0,2} d(?: e)? f(?= |$)")
    automaton = license_scan.TokenAutomaton(template)
    longest = license_scan.TokenAutomaton("a [[b]] {{v:0-2}}")
    assert longest.ends([b"a", b"b", b"c", b"d", b"e"], 0) == 4 and longest.ends([b"a"], 0) == 1
    for _ in range(3000):
        words = rng.choice(list("abcdefg"), rng.integers(0, 12)).tolist()
        text = " ".join(words)
        joined = f" {text} ".encode()
        assert (automaton.found([w.encode() for w in words], joined) is not None) == bool(pattern.search(text)), text


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, edges):
        want = Counter((r["doc_id"], brute_quality(r["text"])) for r in table.collect())
        got = quality_rules.quality_rules(table, into="r").select("doc_id", "r.*").collect()
        assert Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality_rules.quality_filter(edges)
    assert kept.columns == edges.columns


def test_fertility_against_the_libraries():
    """Figures of words, each as often as it stands, are those of all tokens one after the other."""
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(quality_rules.FALLBACK_VOCABULARY))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(quality_rules.MANY_LANGUAGES), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for (text,) in duckdb.sql(f"select text from '{SF}/documents.parquet' where length(text) > 20 limit 50").fetchall():
        got = quality_rules.measure(text.encode(), "en")
        ids = [i for w in text.split() for i in model.encode(w)]
        share = np.array(list(Counter(ids).values())) / len(ids)
        assert got["tokens"] == len(ids) and np.isclose(got["fallback_share"], np.mean([model.is_byte(i) for i in ids]))
        assert np.isclose(got["token_entropy"], -(share * np.log2(share)).sum()) and np.isclose(got["chars_per_token"], got["word_chars"] / len(ids))
        assert np.isclose(got["chars_per_other_token"], got["word_chars"] / sum(len(other.encode_ordinary(f" {w}")) for w in text.split()))


def test_fertility_bands():
    words = [b"the", b"quick"]
    n, per, fallback, entropy, _ = quality_rules.fertility(words, np.ones(2, np.int64), 8)
    assert n > 0 and per == 8 / n and fallback == 0 and entropy > 0
    assert quality_rules.fertility(["\U0001f9ff".encode()], np.ones(1, np.int64), 1)[2] > 0
    assert not quality_rules.measure("\U0001f9ff ".encode() * 100, "en")["kept"]
    short = " ".join(f"{a}{b}" for a in ("river", "stone", "cloud", "light", "paper", "glass", "house", "table") for b in ("", "s", "side", "man", "work", "way", "less"))
    assert quality_rules.measure(short.encode(), None)["kept"]  # too short for the whole entropy: the bound falls with it
    assert not quality_rules.measure(("xq#z " * 55).encode(), "en")["kept"]


def test_fertility_tells_junk_that_the_base_rules_miss():
    """On labelled documents with odd ids; the bands come from even ones."""
    docs, labels = (duckdb.sql(f"select * from '/root/testdata/sf0.1/{t}.parquet'") for t in ("documents", "labels"))
    rows = duckdb.sql("select text, lang, quality from docs join labels using (doc_id) where doc_id % 2 = 1 and quality is not null").fetchall()
    kept = {0: [], 1: []}
    for text, lang, quality in rows:
        got = quality_rules.measure(text.encode(), lang)
        if not got["base_failed"]:
            kept[quality].append(got["kept"])
    assert np.mean(kept[0]) < 0.1 and np.mean(kept[1]) > 0.97


def test_token_counts_match_the_library(spark, edges):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edges.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(90, "a<|endoftext|>b <|endoftext|>"), (91, "don't  we'LL\n\n  it's 's"), (92, "'re've 12ab½ ٣"), (93, "<|endoftext|>")], docs.schema))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, into="r").select("doc_id", "r.*").collect())
    assert got == Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())


def test_bytes_that_are_not_utf8(spark):
    rows = spark.sql("select 1 doc_id, cast(X'61C32861' as string) text, cast(null as string) lang union all select 2, 'plain', null")
    got = {r["doc_id"]: r for r in token_counts.token_counts(rows, into="r").select("doc_id", "r.*").collect()}
    assert got[1]["n_bytes"] == 4 and got[1]["n_tokens"] > 0 and got[2]["n_tokens"] == 1
    assert license_scan.license_scan(rows).count() == quality_rules.quality_rules(rows).count() == 2


def test_columns_of_any_name_stay(spark, edges):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")
    for name in ("quality", "_quality", "toxicity", "__toxicity", "content", "times"):
        marked = edges.select("doc_id", F.lit("a b c d e").alias("text"), "lang", F.lit("mine").alias(name))
        assert quality_rules.quality_filter(marked).columns == marked.columns
        kept = toxicity.toxicity_filter(marked, labels, threshold=2.0)
        assert kept.columns == marked.columns and {r[name] for r in kept.collect()} == {"mine"}


def test_toxicity_sample_is_limited_by_rows(spark):
    docs = spark.createDataFrame([(i % 3, f"word{i % 50} text", ) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    sizes = []
    real = toxicity.calibrated
    try:
        toxicity.calibrated = lambda terms, marks: sizes.append((len(terms), len(marks))) or real(terms, marks)
        toxicity.trained(docs, labels, sample=70)
    finally:
        toxicity.calibrated = real
    assert sizes == [(70, 70)]


def test_pieces_against_the_pattern():
    import regex

    rng = np.random.default_rng(2)
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    table = token_counts.character_classes()
    for _ in range(2000):
        text = "".join(rng.choice(list("'streavlmd B1 \n\t.!é日"), rng.integers(1, 150)))
        classes = np.append(table[[ord(c) for c in text]], token_counts.RESET).astype(np.uint8)
        starts = np.flatnonzero(token_counts.piece_starts(classes, chunk=int(rng.integers(1, 40))))[:-1]
        assert starts.tolist() == [m.start() for m in pattern.finditer(text)], repr(text)


def test_composition_is_the_run_of_the_machine():
    rng = np.random.default_rng(3)
    maps = rng.integers(0, token_counts.STATES, (37, token_counts.STATES)).astype(np.uint8)
    state, want = np.arange(token_counts.STATES), []
    for m in maps:
        state = m[state]
        want.append(state)
    assert (token_counts.composed(maps) == np.array(want)).all()


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = queries.op10_toxicity(spark, sf)
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    score, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    caught = np.array([r["predicted"] for r in rows])
    assert auc > 0.95 and caught[y == 1].mean() > 0.6 and caught[y == 0].mean() < 0.01
    assert scored.count() == docs.count()


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(edges, labels, into="p").select("p").collect()
    assert len(got) == len(EDGES) and all(0 <= r["p"] <= 1 for r in got)
    assert toxicity.toxicity_filter(edges.where("false"), labels).count() == 0
    assert toxicity.toxicity_filter(edges, labels).columns == edges.columns


def test_factorization_machine_learns_a_pair():
    """Neither term tells by itself; both together do."""
    rng = np.random.default_rng(4)
    docs, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        docs.append(np.array(sorted({*([10] if a else [11]), *([20] if b else [21]), *rng.integers(1000, 3000, 5)}), np.int32))
        y.append(int(a and b))
    model = toxicity.FactorizationMachine(-3.0, np.zeros(1 << toxicity.BITS), np.zeros((1 << toxicity.BITS, toxicity.RANK)))
    model.factors[10] = model.factors[20] = [2.5, 0, 0, 0]
    z = model.logits(np.concatenate(docs), np.cumsum([len(d) for d in docs]))
    assert ((z > 0) == np.array(y, bool)).all()
    direct = [-3.0 + sum(model.factors[i] @ model.factors[j] for n, i in enumerate(d) for j in d[n + 1 :]) for d in docs[:50]]
    assert np.allclose(z[:50], direct)


def test_fit_learns_a_label_that_only_a_pair_explains():
    """Toxic documents have both terms; 45 in a hundred clean ones have the one, 45 the other."""
    rng = np.random.default_rng(4)

    def drawn(n):
        toxic, u = rng.random(n) < 0.1, rng.random(n)
        docs = [np.array(sorted({*([10] if y or x < 0.45 else []), *([20] if y or 0.45 <= x < 0.9 else []), *rng.integers(1000, 3000, 20)}), np.int32) for y, x in zip(toxic, u)]
        return docs, toxic.astype(int)

    model = toxicity.fit(*drawn(4000))
    docs, y = drawn(2000)
    z = model.logits(np.concatenate(docs), np.cumsum([len(d) for d in docs]))
    assert (z[y == 1] > 0).mean() > 0.95 and (z[y == 0] < 0).mean() > 0.95


def test_empty_tables(spark, edges):
    none = edges.where("false")
    assert license_scan.license_scan(none).count() == quality_rules.quality_rules(none).count() == token_counts.token_counts(none).count() == 0
