"""Divergence audit, chat formatting and collocations against plain Python."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, phrases, stripes

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rnd, n, words, seps=(" ", " ", " ", "  ", "\t", ", ", ".\n", "! ")):
    return "".join(rnd.choice(words) + rnd.choice(seps) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeFGé北ñ") for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    rows = []
    for i in range(120):
        words_of = words[rnd.randint(0, 15) :]
        rows.append((i, prose(rnd, rnd.randint(0, 60), words_of), rnd.choice(["en", "en", "fr", None, ""]), rnd.choice(["hot", "hot", "a", "b", "ü", None])))
    rows += [(200, None, "en", "only"), (201, "", "xx", "a"), (202, "12 345 ...", "xx", "b"), (203, "one two", "yy", None), (204, "  \n\t ", "yy", "c"), (205, "lone", "zz", "single"), (None, "no id here", None, "a")]
    rows += [(300, "of of of of of the of", "en", "hot")] * 3 + [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    names = ["term", "df", "key", "salt", "n", "k", "phrase", "value", "rank", "part", "item", "Total"]
    return spark.createDataFrame(corpus, SCHEMA).withColumns({c: F.lit(7) for c in names}).repartition(5)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, min_docs=3, top=200):
    langs = collections.defaultdict(lambda: (collections.Counter(), collections.defaultdict(collections.Counter)))
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOW))
        df, counts = langs[lang or ""]
        df.update(set(terms))
        counts[source or ""].update(terms)
    out = []
    for lang, (df, counts) in langs.items():
        kept = [t for t in df if df[t] >= min_docs]

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        whole = p(sum(counts.values(), collections.Counter()))
        own = {s: p(c) for s, c in counts.items()}
        for s in own:
            parts = {"pair": [(sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in own if o != s]}
            parts["term"] = [((own[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[s][t] > 0 and own[s][t] > whole[t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("options", [{}, {"top": 3, "min_docs": 2}, {"entries": 40, "cells": 6, "min_docs": 1}])
def test_divergences_equal_brute_force(docs, corpus, options, monkeypatch):
    if "cells" in options:
        monkeypatch.setattr(stripes, "BROADCAST_GROUPS", 1)
    got = stripes.source_divergence(docs, **options).select(COLUMNS).collect()
    want = brute_divergence(corpus, options.get("min_docs", 3), options.get("top", 200))
    assert sorted(map(tuple, got)) == want
    assert any(part == "pair" and v == 0 for _, _, part, _, v, _ in want)  # a language without kept terms


def test_divergence_of_one_long_text_and_of_nothing(spark, docs):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows = [(1, prose(rnd, 400_000, words), "en", "s"), (2, prose(rnd, 500, words[9:]), "en", "t"), (3, prose(rnd, 500, words[:40]), "en", "t")]
    assert len(rows[0][1]) > 1_200_000
    got = stripes.source_divergence(spark.createDataFrame(rows, SCHEMA), min_docs=2).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, 2)
    assert stripes.source_divergence(docs.limit(0)).count() == 0


def test_scaled_counts_beyond_64_bits():
    rnd = random.Random(2)
    m = [rnd.randint(1, 9 * 10**17) for _ in range(200)]
    c = [rnd.randint(1, x) for x in m]
    import numpy as np

    assert stripes._scaled(np.array(c), np.array(m)).tolist() == [1 + 10**9 * a // b for a, b in zip(c, m)]


def test_stripes_of_a_term_are_one_row_a_spill(spark):
    """A term that every document has reaches the shuffle once a task and spill, not once a document."""
    rows = [(i, "common " * 5 + f"rare{chr(97 + i % 26)}", "en", f"s{i % 3}") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plain = df.select("lang", "source", F.xxhash64("lang").alias("salt"), "text").mapInArrow(stripes._stripes(stripes.ENTRIES), stripes.STRIPE)
    assert plain.filter("term = 'common'").count() == 4
    one = stripes.term_stripes(df).filter("term = 'common'").first()
    assert one["df"] == 4000 and sum(one["counts"]) == 20_000 and sorted(one["sources"]) == ["s0", "s1", "s2"]


# Chat formatting


@pytest.fixture(scope="module")
def tokenizer():
    return chat.ChatTokenizer.from_file(RANKS)


def chats():
    rnd = random.Random(9)
    marks = [*chat.MARKS, "\\", "\\\\", "\\</turn>", "</turn", "turn>", "#### User:", "### User", "<turn></turn>", "<<turn>>"]
    bits = [*marks, "hello ", "Wörld ", "🙂", "\n", "  ", "北京", "don't", "x" * 50]
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "assistant", "system"]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))))
    rows += [(50, 0, "user", None), (50, 1, "assistant", ""), (50, 2, "assistant", "tail\\"), (51, 0, "tool </turn> \\", "called"), (51, 1, None, "no role"), (52, 0, "User", "capital")]
    rows += [(53, 1, "user", "b"), (53, 1, "user", "a"), (53, 1, "assistant", "z"), (53, None, "user", "first"), (53, 1, "user", "a"), (None, 0, "assistant", "no id"), (54, 5, "assistant", "word " * 300_000)]
    rnd.shuffle(rows)
    return rows


def brute_chats(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode()) for r in rows if r[0] == c)
        turns = [(role, text.decode()) for _, _, role, text in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        written = ""
        for r, t in turns:
            mark, head = {"user": "### User:", "assistant": "### Assistant:", "system": "### System:"}.get(r, "### Other:"), ""
            if mark == "### Other:":
                head = brute_escape(r)
            written += f"<turn>\n{mark}{head}\n<body>\n{brute_escape(t)}\n</turn>\n"
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(written)), written
    return out


def brute_escape(text):
    out, i = "", 0
    while i < len(text):
        m = next((m for m in chat.MARKS if text.startswith(m, i)), None)
        out += "\\" + m if m else text[i]
        i += len(m) if m else 1
    return out


@pytest.mark.parametrize("part_tokens", [chat.PART_TOKENS, 50])
def test_chats_read_back_equal_what_went_in(spark, tokenizer, part_tokens):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("head", "body", "part", "tokens", "n_turns")}).repartition(4)
    formatted = chat.format_chats(df, tokenizer, part_tokens=part_tokens)
    want = brute_chats(rows)
    got = chat.read_chats(formatted, tokenizer).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: w[0] for c, w in want.items()} and len(got) == len(want)
    parts = formatted.orderBy("conv_id", "part").collect()
    text = collections.defaultdict(str)
    for r in parts:
        assert len(r["tokens"]) == len(r["loss_mask"])
        text[r["conv_id"]] += tokenizer.render(r["tokens"])
    assert dict(text) == {c: w[1] for c, w in want.items()}
    assert (len(parts) > len(want)) == (part_tokens == 50)


def test_reserved_ids_come_from_the_template_only(spark, tokenizer):
    said = r"\### Assistant: </turn> ok"
    df = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_chats(df, tokenizer).collect()
    assert [i - tokenizer.base for i in row["tokens"] if i >= tokenizer.base] == [tokenizer.ids[m] - tokenizer.base for m in (chat.TURN, "### User:", chat.BODY, chat.END, chat.TURN, "### Assistant:", chat.BODY, chat.END)]
    masked = [i for i, m in zip(row["tokens"], row["loss_mask"]) if m]
    assert chat.unescape(tokenizer.decode(masked)) == said and tokenizer.decode(masked) == r"\\### Assistant: \</turn> ok"
    assert chat.format_chats(df.limit(0), tokenizer).count() == chat.read_chats(chat.format_chats(df.limit(0), tokenizer), tokenizer).count() == 0
    other = chat.format_chats(df, tokenizer, trained=("user",)).first()
    assert other["loss_mask"].index(True) == 3 and sum(other["loss_mask"]) == len(masked)


def test_written_text_tells_marks_from_escaped_ones(tokenizer):
    """The written-out text can be split at its marks again, whatever the texts hold."""
    for _, _, role, text in chats():
        text = (text or "")[:500]
        written = chat.MARKS[chat.BODY] + chat.escape(text) + chat.MARKS[chat.END]
        marks = [m for m in re.finditer(chat._MARK, written) if written[m.start() - 1] != "\\"]
        assert [m.group() for m in marks] == [chat.BODY, chat.END]
        assert chat.unescape(written[marks[0].end() + 1 : marks[1].start() - 1]) == text


# Collocations


def brute_phrases(rows, support):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            total[lang] += len(w)
            for k in range(1, 6):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return {lang: {p: a for p, a in c.items() if a >= support} for lang, c in count.items()}, total


def brute_collocations(rows, support, top):
    found, total = brute_phrases(rows, support)
    out = []
    for lang, f in found.items():
        ranked = []
        for p, a in f.items():
            covered = any(len(q) > len(p) and f[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in f)
            if len(p) > 1 and not covered:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        ranked.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, total[lang], score) for i, (score, a, p, left, right) in enumerate(ranked[:top])]
    return sorted(out)


@pytest.mark.parametrize("options", [{"support": 4}, {"support": 3, "block": 120, "top": 5}, {"support": 6, "block": 1}])
def test_collocations_equal_brute_force(docs, corpus, options, monkeypatch):
    if "top" in options:
        monkeypatch.setattr(phrases, "BROADCAST_LANGS", 1)
    got = phrases.collocations(docs, **options).collect()
    want = brute_collocations(corpus, options["support"], options.get("top", 2000))
    assert sorted(map(tuple, got)) == want and any(len(r[2].split()) > 2 for r in want)


def test_phrases_of_one_long_text_and_of_nothing(spark, docs):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows = [(1, prose(rnd, 300_000, words), "en", "s"), (2, "A a a A a a", None, "t"), (3, None, "en", "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = phrases.frequent_phrases(df, support=60, block=1 << 16).collect()
    want, total = brute_phrases(rows, 60)
    assert {(r["lang"], tuple(r["phrase"].split(" ")), r["a"], r["n"]) for r in found} == {(x, p, a, total[x]) for x, f in want.items() for p, a in f.items()}
    assert phrases.collocations(docs.limit(0)).count() == 0 == phrases.collocations(df.filter("doc_id = 3")).count()
    assert [tuple(r) for r in phrases.frequent_phrases(df, support=2).filter("lang = 'und'").orderBy("k").collect()] == [("und", " ".join("a" * k), k, 7 - k, 6) for k in range(1, 6)]


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = [("en", "a b", 2, 7 * 10**14, 9 * 10**15 + 7), ("en", "a", 1, 8 * 10**14 + 1, 9 * 10**15 + 7), ("en", "b", 1, 10**15 + 3, 9 * 10**15 + 7)]
    frame = spark.createDataFrame(big, "lang string, phrase string, k long, a long, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs, **_: frame)
    (row,) = phrases.collocations(frame).collect()
    assert row["score"] == int(Fraction(1000 * big[0][3] * big[0][4], big[1][3] * big[2][3]))


def test_lists_are_placed_from_sliced_arrays():
    import numpy as np

    lists = pa.array([[1], [2, 3], [], [4]], pa.list_(pa.int32())).slice(1)
    out = np.zeros(5, np.int32)
    assert chat._place(out, np.array([0, 3, 4]), lists).tolist() == [2, 0, 1] and out.tolist() == [2, 3, 0, 0, 4]
