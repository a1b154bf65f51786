"""The text operators against the public library or brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import bpe, chat, fingerprints, licenses, token_counts, token_files

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (None, "no id at all, under the MIT license"), (5, "the same row twice"), (5, "the same row twice"),
    (6, "long word " * 6000), (7, "ünïcode ẞ İ K \U0001f600\r\nline"), (8, "one two three"), (9, "One  TWO three"),
    (10, "x" * 5000), (11, "12345 don't <|endoftext|> it's    spaced"), (12, "Apache License, Version 2.0 and CC-BY-NC, cc by nc"),
]
CLASHES = ("node", "key", "size", "_id", "_key", "_words", "n_words", "_at", "head", "ids")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_encoding_is_the_librarys(spark, docs, library):
    got = order((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == order(want)
    assert bpe.encode_decode(empty(spark)).count() == 0


def test_backtracking_gives_exact_merges(library):
    rng, own = random.Random(5), bpe.load(bpe.vocabulary_path())
    for _ in range(400):
        text = "".join(rng.choice("aabcdeeinrst  \n.'é0中") for _ in range(rng.randrange(60)))
        assert own.ids(text) == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_read_back(spark, docs, library, tmp_path):
    got = token_files.read(spark, token_files.write(docs, f"file://{tmp_path}/a")).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.read(spark, token_files.write(empty(spark), f"file://{tmp_path}/b")).count() == 0


def test_damaged_frame_is_noticed(spark, tmp_path):
    file = token_files.write(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), f"file://{tmp_path}/c").first()["file"]
    path = file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[9] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  zstandard's or the checksum's
        token_files.Reader(file).ids(0)


def test_counts_follow_edits(library):
    rng, counts = random.Random(9), token_counts._counts(bpe.vocabulary_path())
    signs = ["word", " ", "  ", "\n", "don't", "12", "é", ".", " the", "\U0001f600", "<|endoftext|>", "<|endof", "text|>", "<|", "|>"]
    for k in range(120):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(400)))
        tree = token_counts.CountTree.build(counts, text)
        for _ in range(12):
            a = rng.randrange(len(text) + 3)
            b, new = a + rng.randrange(40 if k % 3 else 400), "".join(rng.choice(signs) for _ in range(rng.randrange(4 if k % 5 else 200)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[max(b, a) :]
            assert tree.text == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
            assert max(len(tree._leaf(k)[1]) for k in range(len(tree.leaves))) <= 2 * token_counts.LEAF
            if rng.random() < 0.3:  # through a table row
                tree = token_counts.CountTree(counts, *tree.kept())


def test_an_edit_reads_little_of_a_long_text(library):
    counts = token_counts._counts(bpe.vocabulary_path())
    tree = token_counts.CountTree.build(counts, "some words of a long text. " * 20_000)
    for k in range(50):
        tree.edit(10_000 * k, 10_000 * k + 3, " put in <|endoftext|>")
    assert tree.encoded_chars < 50 * 200
    assert tree.n_tokens == len(library.encode(tree.text, add_special_tokens=False).ids)


def test_edited_counts_of_odd_rows(spark, docs, library):
    edit = lambda a, b, t: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(t).alias("text")))
    once = token_counts.edited(token_counts.count_trees(docs).withColumn("edits", edit(2, 4, " new")))
    again = token_counts.edited(once.withColumn("edits", edit(0, 1, None)))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    first = lambda t: t[:2] + " new" + t[4:]
    for got, text in ((once, first), (again, lambda t: first(t)[1:])):
        assert order((r.doc_id, r.text, r.built_tokens, r.n_tokens) for r in got.collect()) == order((i, text(t or ""), n(t or ""), n(text(t or ""))) for i, t in ROWS)
    assert token_counts.edited(token_counts.count_trees(empty(spark)).withColumn("edits", F.lit(None))).count() == 0


def test_chats_come_back(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", probe), (2, 1, "assistant", "a\\b<s><\\s>"), (None, 0, "assistant", "x"), (3, None, None, ""), (4, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (5, 0, "[INST]", "l" * 50_000)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1)).withColumn("formatted", F.lit(1))
    out = chat.format_chats(chats).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("mask"), F.col("escaped"))).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda x: tuple((v is not None, v) for v in x)):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    assert all(r["identical"] for r in out) and {r["conv_id"] for r in out if r["escaped"]} == {2, 5}
    assert {r["conv_id"]: r["loss"] for r in out} == {c: "".join(x for r, x in t if r == "assistant") for c, t in want.items()}
    assert chat.format_chats(chats.where("false")).count() == 0


@pytest.mark.parametrize("bits, at_once", [(128, fingerprints.BROADCAST), (3, fingerprints.BROADCAST), (3, 0)])
def test_fingerprints_tell_canonical_texts_apart(spark, docs, bits, at_once, monkeypatch):
    monkeypatch.setattr(fingerprints, "BROADCAST", at_once)
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    got = fingerprints.fingerprint(docs, bits=bits).collect()
    rows = sorted(((i, t or "") for i, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    edited = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited.setdefault(i, t[: len(t) - len(t) // 2] + following[: len(t) // 2])
        if i != 5:
            assert by[i]["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest() and by[i]["n_chars"] == len(t)
            assert by[i]["near_edited"] == float(fold(t) == fold(edited[i])) and by[i]["near_next"] == float(fold(t) == fold(following))
    prints = {i: by[i]["fingerprint"] for i, _ in rows} | {("edited", i): by[i]["edited_fingerprint"] for i, _ in rows if i != 5}
    texts = dict(rows) | {("edited", i): edited[i] for i in edited if i != 5}
    assert all((prints[a] == prints[b]) == (fold(texts[a]) == fold(texts[b])) for a in prints for b in prints)
    assert fingerprints.fingerprint(empty(spark), bits=bits).count() == 0


def test_licences_match_brute_force(spark, docs):
    phrases = {k: tuple(k.split()) for k in licenses.PHRASES}

    def brute(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, licenses.PHRASES[k]) for k, p in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        out = licenses.scan(df).collect()
        assert order(tuple(r[c] for c in columns) for r in out) == order((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect())
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)
    assert licenses.scan(empty(spark)).count() == 0


def licence_labels(texts):
    """doc by doc: the labels and best score of every licence at every place, by the definition."""
    cut = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t in texts]
    weight = {w: math.log1p((1 + len(texts)) / (1 + sum(w in set(c) for c in cut))) for w in licenses.VOCABULARY}
    out = []
    for own in cut:
        labels, best = set(), 0.0
        at = lambda phrase: [i for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]  # noqa: B023, E731
        base = {licenses.PHRASES[k] for k in licenses.PHRASES if at(k)}
        for label, template, phrase in licenses.TEMPLATES:
            t = template.split()
            order = sorted(set(t), key=lambda w: (-weight[w], w))
            total = sum(weight[w] for w in order[: licenses.RAREST])
            sums = {}
            for w in [w for w in order if w in own][: licenses.RAREST]:
                for i, x in enumerate(own):
                    for j in [j for j, y in enumerate(t) if x == y == w]:
                        sums[i - j] = sums.get(i - j, 0) + weight[w] / t.count(w)
            for start, got in sums.items():
                if got >= licenses.LEAST_SCORE * total - 1e-9 and any(start - licenses.SLACK <= p <= start + len(t) + licenses.SLACK for p in at(phrase)):
                    labels.add(label)
                    best = max(best, min(1.0, got / total))
        out.append((",".join(sorted(labels | base)), 1.0 if base else best))
    return out


def test_licence_labels_match_brute_force(spark):
    rng = random.Random(15)
    prose = lambda n: " ".join(rng.choice("the of software and to any copy house river without water notice year free use".split()) for _ in range(n))
    texts = [prose(rng.randrange(80)) for _ in range(20)] + ["", "All rights reserved. " * 200, "under the MIT license. " * 300]
    for _, text, _ in licenses.LICENCES:
        w = text.split()
        for share in (0, 10, 25, 50):  # whole licences, and ones with words replaced
            for k in rng.sample(range(len(w)), len(w) * share // 100):
                w[k] = rng.choice(["foo", "the", "software"])
            texts.append(f"{prose(30)}\n{' '.join(w)}\n{prose(30)}")
    texts += [f"{a[1]} {prose(5)} {b[1]}" for a, b in zip(licenses.LICENCES, licenses.LICENCES[1:])]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    want = licence_labels(texts)
    assert [r["labels"] for r in out] == [label for label, _ in want]
    assert all(abs(r["score"] - score) < 2e-6 for r, (_, score) in zip(out, want))
    whole = [want[23 + 4 * k][0].split(",") for k in range(len(licenses.LICENCES))]
    assert all(label in found for (label, _, _), found in zip(licenses.LICENCES, whole))
