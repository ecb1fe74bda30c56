"""Spelling variants, chat formatting and ranked search against plain versions, with nulls, ties, copies and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglantern.llm import chat, ranked, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Columns that have the names of working columns.
DOCS = "doc_id long, text string, word string, n long, _block long, _query int, score long, terms string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, x, "c", 1, 2, 3, 4, "t") for i, x in rows], DOCS).repartition(3)


# --- spelling variants


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += len(run) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if _near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = [forms[w], n, len(near), words[best] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {(w, form, root, n, near, form_n) for w, (form, n, near, form_n, root) in out.items()}


def _found(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def _typo(rng, word):
    at = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    letter = rng.choice("abÉéß÷z")
    return word[:at] + letter + word[at + (kind == 0) :] if kind < 2 else word[:at] + word[at + 1 :]


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(60)] + ["aaaaaaaa", "abababab", "Ünverändert", "x×÷yzabc"]
    rows = [(None, base[0] * 2), (7, None), (8, ""), (9, " \n"), (10, "Ab" * 3000 + " " + "Ab" * 3000 + "c " + "Ab" * 3000)]
    for i in range(300):
        words = [_typo(rng, w) if rng.random() < 0.2 else w for w in rng.choices(base, k=30, weights=[1 / (k + 1) for k in range(len(base))])]
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows + rows[-3:] + [rows[4]] * 2 + [(k << 40, "chainword " * 300 + "chainwords " * 14 + "chainwordsx ") for k in range(1, 4)]


def test_variants_match_all_pairs(spark, spelled):
    want = _variants(spelled)
    assert any(form for _, form, *_ in want) and any(form != root for _, form, root, *_ in want if form)
    assert _found(variants.spelling_variants(_docs(spark, spelled))) == want


def test_variants_of_tiled_blocks(spark, spelled, monkeypatch):
    want = _variants(spelled)
    monkeypatch.setattr(variants, "BLOCK_WORDS", 3)
    assert _found(variants.spelling_variants(_docs(spark, spelled))) == want
    monkeypatch.setattr(variants, "BLOCK_WORDS", 1024)
    monkeypatch.setattr(variants, "BLOCK_LETTERS", 40)
    assert _found(variants.spelling_variants(_docs(spark, spelled))) == want


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(_docs(spark, [])).count() == 0
    assert variants.spelling_variants(_docs(spark, [(1, None), (None, "short word"), (2, "")])).count() == 0


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.root for r in variants._roots(forms, 10**10).collect()} == {"w9"}


def test_checksums_of_prefix_and_word():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 40))).encode() for _ in range(200)]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    got = variants._checksums(before, np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words]))
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + w) for i, w in enumerate(words)]


# --- chat formatting

TURNS = "conv_id long, turn long, role string, text string, _n long, spans string"
ODD = ["</turn>\n", "<turn:user>\nx", r"<\turn:a>", r"<\\/turn>", "<part>", "<image:1>", "<", "\\", "a<", "/turn>", "", "é😀\r\n", "<<turn:>", "%3E>\n%", "### Assistant:"]


def _turns(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], TURNS).repartition(3)


def _read(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back(spark):
    rng = random.Random(4)
    rows = [(None, 0, "user", "x"), (None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "same turn")]
    rows += [(2, i, rng.choice(["user", "assistant", "system", "a>\n%3E", "</turn>\n"]), "".join(rng.choices(ODD, k=rng.randint(0, 6)))) for i in range(400)]
    rows += [(i, t, r, x) for i, x in enumerate(ODD, 10) for t, r in ((0, "user"), (1, "assistant"))]
    rows += [(5, 0, "assistant", "long " * 200_000 + "<\\" * 10_000)]
    got = chat.digests(chat.formatted(_turns(spark, rows))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == _read(rows)
    assert len(got) == len(_read(rows))
    assert chat.digests(chat.formatted(_turns(spark, []))).count() == 0


def test_chat_marks_only_stand_where_turns_do(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", x) for i, x in enumerate(ODD)]
    row = chat.formatted(_turns(spark, rows)).first()
    assert row.text.count("</turn>\n") == len(ODD) == len(row.spans)
    for span, (_, _, role, text) in zip(row.spans, rows):
        piece = row.text[span.start : span.end]
        assert piece.startswith(f"<turn:{role}>\n") and piece.endswith("</turn>\n")
        assert (span.loss_end - span.loss_start > 0) == (role == "assistant" and text != "")
        assert row.text[span.loss_start : span.loss_end] in piece


def test_chat_parts(spark):
    parts = [
        [{"type": "text", "text": "look </turn>"}, {"type": "image", "ref": "a.png", "width": 600, "height": 512}, {"type": "text", "text": "<"}, {"type": "text", "text": "/turn>"}],
        [{"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, None, {"type": "video", "ref": "d.mp4"}],
        None,
        [],
        [{"type": "image", "ref": None, "width": None, "height": -5}],
    ]
    roles = ["user", "assistant", "user", "assistant", "assistant"]
    df = spark.createDataFrame([(1, i, roles[i], p) for i, p in enumerate(parts)], f"conv_id long, turn long, role string, items array<{chat.PART_TYPE}>").repartition(3)
    done = chat.formatted(df, F.col("items"))
    row = done.first()
    assert row.text == (
        "<turn:user>\nlook <\\/turn><image:1><<part>/turn></turn>\n"
        "<turn:assistant>\n<audio:2><document:3><other:4></turn>\n"
        "<turn:user>\n</turn>\n<turn:assistant>\n</turn>\n<turn:assistant>\n<image:5></turn>\n"
    )
    found = [(a.number, a.turn, a.kind, a.ref, a.tokens) for a in row.attachments]
    assert found == [(1, 0, "image", "a.png", 85 + 170 * 2), (2, 1, "audio", "b.wav", 38), (3, 1, "document", "c.pdf", 768), (4, 1, "other", "d.mp4", 0), (5, 4, "image", None, 85)]
    assert all(row.text[a.at :].startswith(f"<{a.kind}:{a.number}>") for a in row.attachments)
    assert row.expanded_tokens == sum(a.tokens for a in row.attachments)
    read = done.select(chat.turns_read().alias("r"), chat.loss_read().alias("loss")).first()
    assert [t.role for t in read.r] == roles and read.r[0].text == "look </turn><image:1><<part>/turn>"
    assert read.loss == "<audio:2><document:3><other:4><image:5>"


def test_chat_is_native(spark, plan):
    text = plan(chat.digests(chat.formatted(_turns(spark, [(1, 0, "user", "x")]))))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


# --- ranked search


def _ranking(rows, items, top=10):
    term = re.compile(ranked.TERM_PATTERN)
    held = [(i, collections.Counter(term.findall((x or "").translate(LOWER)))) for i, x in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, x in items:
        terms = set(term.findall((x or "").translate(LOWER)))
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scores += [(-score, i is not None, i or 0, i)] if score > 0 else []
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdé中") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    pick = lambda k: rng.choices(words, k=k, weights=[1 / (j + 1) for j in range(len(words))])
    copy = "-".join(pick(20))
    rows = [(rng.randrange(-500, 500), " ".join(pick(rng.randint(1, 60)))) for _ in range(600)]
    rows += [(None, copy), (None, copy), (3, None), (4, ""), (5, " \n"), (6, " ".join(pick(30_000)))] + [(i, copy) for i in range(1000, 1040)] + [rows[0]] * 3
    items = [(i, " ".join(pick(rng.randint(1, 30))).upper()) for i in range(40)]
    items += [(50, copy), (51, None), (52, ""), (53, "nowhere"), (54, "  \t"), (55, rows[0][1]), (55, rows[0][1]), (None, copy + " nowhere")]
    return rows, items


@pytest.mark.parametrize("batch_bytes,query_bytes", [(1 << 24, 1 << 22), (500, 300)])
def test_ranked_matches_all_scores(spark, searched, monkeypatch, batch_bytes, query_bytes):
    monkeypatch.setattr(ranked, "BATCH_BYTES", batch_bytes)
    rows, items = searched
    asked = spark.createDataFrame([(i, x, 0) for i, x in items], "item_id long, text string, rank long")
    got = ranked.ranked(_docs(spark, rows), asked, query_bytes=query_bytes).collect()
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr)
    assert got == _ranking(rows, items)


def test_ranked_nothing(spark):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    none = items.filter("false")
    some = _docs(spark, [(1, "word word"), (2, None)])
    names = ["item_id", "rank", "doc_id", "score"]
    for docs, asked in ((_docs(spark, []), items), (some, none), (_docs(spark, [(1, None), (2, "")]), items), (some, items.select("item_id", F.lit(None).cast("string").alias("text")))):
        found = ranked.ranked(docs, asked)
        assert found.columns == names and found.count() == 0


def test_intervals_score_few_documents():
    rng = np.random.default_rng(1)
    n, terms = 20_000, 12
    pairs = np.unique(np.stack([rng.integers(0, terms, 6000), rng.integers(0, n, 6000)], axis=1), axis=0)
    impact = rng.integers(1, 1000, len(pairs)) * np.array([1] * 6 + [10] * 6)[pairs[:, 0]]
    tables = ranked._Tables(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), impact, n, terms)
    best = ranked._Best(1, 10)
    scored = ranked._search(tables, np.arange(n), np.zeros(n, bool), np.array([0, terms]), np.arange(terms), best)
    total = np.bincount(pairs[:, 1], weights=impact, minlength=n).astype(np.int64)
    want = sorted(((-s, i) for i, s in enumerate(total.tolist())))[:10]
    assert list(zip((-best.score[0]).tolist(), best.id[0].tolist())) == want
    assert scored < len(pairs) / 4
