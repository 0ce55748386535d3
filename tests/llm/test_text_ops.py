"""Operators on single texts against plain Python: repetition, language, token counts, licenses, pseudonyms."""

import collections
import datetime as dt
import hashlib
import hmac
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, licenses, pseudonyms, quality, text, token_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RND = random.Random(11)
VOCAB = ["".join(RND.choice("abcdeéüñ") for _ in range(RND.randint(1, 7))) for _ in range(60)]


def prose(n, rnd=RND):
    return "".join(w + rnd.choice([" ", " ", "\n", "\t", ".\n\n"]) for w in (rnd.choice(VOCAB) for _ in range(n)))


TEXTS = [None, "", " \n\t ", "one", "a b c d", "A b C d e", prose(19), prose(20), prose(300), (prose(12) + "\n") * 5, "x y z w v u t s r q " * 9, "word " * 60, prose(20_000), " nb sp a", "dup line\nother\ndup line\n\n\n", "é" * 50, "%%% ### *** " * 9, prose(40), "end\n"]
TEXTS += [TEXTS[8], TEXTS[8]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2, True, "n", 5) for i, t in enumerate(TEXTS)] + [(None, "no id here at all", "x", 1, 2, True, "n", 5), (3, "one", "x", 1, 2, True, "n", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, c int, kept boolean, key string, n_tokens int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_word_spans_and_hashes_equal_a_regular_expression():
    col = pa.array(TEXTS)
    seen, i = {}, 0
    for lo, hi, buf, offs in text.chunks(col, 1000):
        w = text.words(buf, offs)
        h = w.hashes()
        for r in range(hi - lo):
            want = WORD.findall(TEXTS[lo + r] or "")
            a, b = w.offs[r], w.offs[r + 1]
            got = [bytes(buf[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])]
            assert got == want
            for word, x in zip(want, h[a:b].tolist()):
                key = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in word)
                assert seen.setdefault(key, x) == x
            i += 1
    assert i == len(TEXTS) and len(set(seen.values())) == len(seen)


def test_repetition_equals_brute_force(docs):
    for r in quality.repetition(docs).filter("doc_id is not null").collect():
        t = (TEXTS + [])[r["doc_id"]] or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)

        def covered(n):
            c = collections.Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
            return {k for j in range(len(w) - n + 1) if c[tuple(w[j : j + n])] > 1 for k in range(j, j + n)}

        rep = covered(8)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(rep))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(rep) > 30 * len(w))
        chars = sum(map(len, w)) or 1
        for n in quality.NGRAM_LIMITS:
            assert r[f"dup_{n}gram_share"] == pytest.approx(sum(len(w[k]) for k in covered(n)) / chars)
        assert not (r["kept"] and r["base_failed"])


def test_keep_good_keeps_columns_and_clean_rows(docs, empty):
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {7, 8, 12, 17, 19, 20}
    assert quality.repetition(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_language_learns_from_labels_only(spark):
    rnd = random.Random(2)
    words = {"aa": ["el", "la", "que", "ñandu", "perro"], "bb": ["the", "and", "which", "dog", "th"]}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(30)), k) for i in range(80) for k in [rnd.choice(["aa", "bb"])]]
    extra = [(100, None, "aa"), (101, "", "bb"), (102, "12 %% 5", None), (103, "perro que", None), (104, "Ё Ж 漢字 𝒳", None), (None, "the dog", "aa")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in language.identify_language(df, F.col("doc_id") % 3 == 1).collect()}
    assert len(got) == 86 and all(got[i]["lang_pred"] == k for i, _, k in rows if i % 3 == 1)
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    assert got[104]["lang_pred"] in ("aa", "bb") and all(0 <= r["score"] <= 1 for r in got.values())
    none = language.identify_language(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify_language(df.limit(0), F.lit(False)).count() == 0


def brute_language(train, asked):
    """Naive Bayes over letter n-grams kept as strings, with 65,536 cells a language."""
    def grams(t):
        t = "".join(c.lower() if c.isalpha() else " " for c in t)
        return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n].strip()]

    count = collections.defaultdict(collections.Counter)
    docs = collections.Counter(k for _, k in train)
    for t, k in train:
        count[k].update(grams(t))
    out = []
    for t in asked:
        logs = {k: math.log(docs[k] / len(train)) + sum(math.log((count[k][g] + 0.5) / (sum(count[k].values()) + 0.5 * 65536)) for g in grams(t)) for k in docs}
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_language_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = [("".join(rnd.choice("abc" if k else "bcd") for _ in range(rnd.randint(1, 9))), "xy"[k]) for k in (rnd.randint(0, 1) for _ in range(60))]
    texts += [(texts[0][0], "x")] * 5
    asked = ["ab cd", "BBBB", "c", "dada", "bc bc", "ab cd", "bcb" * 4000]
    rows = [(i, t, k) for i, (t, k) in enumerate(texts)] + [(1000 + i, t, None) for i, t in enumerate(asked)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"cell": F.lit(1), "held_out": F.lit("x")})
    got = {r["doc_id"]: r for r in language.identify_language(df, F.col("doc_id") >= 1000).collect()}
    for i, (best, score) in enumerate(brute_language(texts, asked)):
        r = got[1000 + i]
        assert abs(r["score"] - score) < 2e-3 and (r["lang_pred"] == best or score < 0.502)
    blocks = {r["doc_id"]: r for r in language.identify_language(df, F.col("doc_id") >= 1000, max_cells=256).collect()}
    assert all((blocks[i]["lang_pred"], pytest.approx(blocks[i]["score"], abs=1e-4)) == (r["lang_pred"], r["score"]) for i, r in got.items())


def test_many_languages_keep_their_buckets(spark):
    """Languages beyond one matrix, in blocks: predictions and probabilities are those of one Bayes over all."""
    rnd = random.Random(12)
    letters = [chr(c) for c in range(0x3B1, 0x3C0)]
    own = {f"l{i:03}": rnd.choices(letters, k=4) for i in range(70)}
    texts = [("".join(rnd.choice(own[k]) for _ in range(rnd.randint(2, 12))), k) for k in own for _ in range(rnd.randint(1, 4))]
    asked = ["".join(rnd.choice(own[k]) for _ in range(6)) for k in list(own)[::9]] + ["".join(letters) * 50, "12", ""]
    rows = [(i, t, k) for i, (t, k) in enumerate(texts)] + [(1000 + i, t, None) for i, t in enumerate(asked)] + [(2000, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify_language(df, F.col("doc_id") >= 1000, max_cells=1 << 21).collect()
    assert len(got) == len(rows) and [r["lang_pred"] for r in got if r["doc_id"] == 2000] == ["und"] * 2
    by = {r["doc_id"]: r for r in got}
    for i, (best, score) in enumerate(brute_language(texts, asked)):
        if asked[i].strip("12"):
            r = by[1000 + i]
            assert abs(r["score"] - score) < 2e-3 and (r["lang_pred"] == best or score < 0.6)
    assert by[1000 + len(asked) - 2]["lang_pred"] == "und" == by[1000 + len(asked) - 1]["lang_pred"]


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_language(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).join(df.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    right, n = got.filter("held_out and n > 40 and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def tokenizer(vocab):
    tokenizers = pytest.importorskip("tokenizers")
    low = min(s for _, s in vocab.pieces)
    pieces = [("<unk>", low)] + vocab.pieces + ([(f"<0x{i:02X}>", low) for i in range(256)] if vocab.byte_fallback else [])
    return tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, vocab.byte_fallback))


SMALL = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("▁a", -5.0), ("aba", -6.0), ("c", -2.5), ("▁▁", -6.0), ("é", -2.0)]


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("crossing", [[], [("a▁b", -3.5)]])
def test_token_counts_and_ties_equal_the_tokenizer(spark, fallback, crossing):
    vocab = token_count.Vocabulary(SMALL + crossing, fallback)
    assert vocab.split == (not crossing)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aabbc é漢\n x") for _ in range(rnd.randint(0, 60))) for _ in range(150)] + ["ab" * 3000, "  a", " ", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    tok = tokenizer(vocab)
    for r in token_count.count_tokens(df, vocab).filter("doc_id is not null").collect():
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == (len(tok.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), t
    assert token_count.count_tokens(df.limit(0), vocab).count() == 0


def test_token_counts_of_a_public_vocabulary(spark):
    vocab = token_count.Vocabulary.from_sentencepiece("/opt/tokenizers/piece_bpe_32k.model")
    tok = tokenizer(vocab)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: len(tok.encode("▁" + r["text"].replace(" ", "▁")).ids) for r in df.collect() if r["text"]}
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(df, vocab).collect()}
    assert all(got[k] == v for k, v in want.items())


def lcs_longest(values):
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] = max([1] + [best[j] + 1 for j in range(i) if values[j] < v])
    return max(best, default=0)


def test_patience_pieces():
    rnd = random.Random(6)
    for _ in range(50):
        v = [rnd.randint(0, 30) for _ in range(rnd.randint(0, 25))]
        at = licenses.longest_increasing(v)
        assert len(at) == lcs_longest(v) and all(v[a] < v[b] for a, b in zip(at, at[1:]))
        a, b = [rnd.choice("abcdefghij") for _ in range(20)], [rnd.choice("abcdefghij") for _ in range(20)]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    same = list("the quick brown fox the")
    assert len(licenses.patience(same, same)) == len(same)


def test_licenses_are_found_in_any_place(spark):
    body = prose(4000)
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("documentation", "doc").replace("merge,", "")
    texts = [None, "", body, body + mit + body, changed.upper(), "Licensed  under\nthe Apache license - version 2.0", "licensed under the", mit[: len(mit) // 2], "Released under the MIT License. " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("coverage", F.lit(0))
    got = licenses.scan_licenses(df).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(3, "MIT"), (4, "MIT"), (5, "Apache-2.0 notice"), (8, "MIT notice")}
    row = next(r for r in got if r["doc_id"] == 3)
    assert texts[3].encode()[row["begin_byte"] : row["end_byte"]].decode().startswith("Permission is hereby") and row["coverage"] == 1.0
    assert licenses.scan_licenses(df.limit(0)).count() == 0 and licenses.scan_licenses(df, {}).count() == 0


def test_licenses_that_follow_one_another(spark):
    mit, notice, gpl = licenses.TEMPLATES["MIT"], "Released under the MIT License.", licenses.TEMPLATES["GPL-3.0 notice"]
    longer = gpl.replace("General", "very General")
    texts = [f"intro words here {notice} {notice} end words", f"intro {notice} " * 4 + "end", f"{prose(50)} {mit} {mit} {prose(50)}", f"start {longer} {longer} {longer} end", f"a b {notice.replace('MIT', '')} c {notice} {notice} d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["coverage"], texts[r["doc_id"]].encode()[r["begin_byte"] : r["end_byte"]].decode()) for r in licenses.scan_licenses(df).collect()}
    want = {(0, "MIT notice"): notice, (1, "MIT notice"): notice, (2, "MIT"): mit, (3, "GPL-3.0 notice"): longer, (4, "MIT notice"): notice}
    assert {k: x for k, (_, x) in got.items()} == {k: x.rstrip(".") for k, x in want.items()} and {x for x, _ in got.values()} == {1.0}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_licenses_equal_a_full_scan(spark):
    """Altered copies between words of the templates, against the longest common subsequence of every stretch."""
    rnd = random.Random(9)
    templates = {"short": "a1 a2 a3 a4 a5", "long": "b1 b2 b3 b1 b4 b5 b6 b2 b7 b8 b9 b1 b10 b11 b12 b13", "repeats": "c1 c2 c1 c2 c1 c3 c4 c1 c2 c5"}
    pool = [w for t in templates.values() for w in t.split()]

    def altered(ws):
        out = []
        for w in ws:
            x = rnd.random()
            out += [] if x < 0.06 else [rnd.choice(pool + ["z"])] if x < 0.12 else [w, "z"] if x < 0.2 else [w]
        return out

    texts = []
    for _ in range(120):
        ws = [rnd.choice(pool + ["z"] * 60) for _ in range(rnd.randint(0, 25))]
        for t in rnd.choices(list(templates.values()), k=rnd.randint(0, 2)) * rnd.randint(1, 2):
            ws += altered(t.split()) + [rnd.choice(pool + ["z"] * 60) for _ in range(rnd.randint(0, 8))]
        texts.append(" ".join(ws))
    want = {}
    for i, t in enumerate(texts):
        ws = t.split()
        for name, x in templates.items():
            x = x.split()
            best = max((lcs(x, ws[j : j + 2 * len(x)]) for j in range(len(ws))), default=0)
            if 100 * best >= 80 * len(x):
                want[i, name] = best
    df = spark.createDataFrame([*enumerate(texts), (None, templates["short"]), (0, texts[0])], "doc_id long, text string").withColumns({"license": F.lit(1), "n_aligned": F.lit(2)})
    rows = licenses.scan_licenses(df, templates).collect()
    assert [r["license"] for r in rows if r["doc_id"] is None] == ["short"]
    got = {(r["doc_id"], r["license"]): r["n_aligned"] for r in rows if r["doc_id"] is not None}
    # A match that lies inside another one's span is not told.
    assert set(got) <= set(want) and all(got[k] <= want[k] for k in got)
    assert len(want) > 60 and len(got) >= 0.95 * len(want)


def test_licenses_of_a_family_and_altered_notices(spark):
    t = licenses.TEMPLATES
    texts = [t["BSD-3-Clause with warranty"], t["BSD-3-Clause"], t["MIT with warranty"], "released under our mit license", "pad " * 60 + t["Apache-2.0 header"] + " " + t["Apache-2.0 header"] + " pad" * 60, f"x {t['ISC']} {t['ISC']} y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r["n_aligned"] / r["n_template"] for r in licenses.scan_licenses(df).collect()}
    assert got == {(0, "BSD-3-Clause with warranty"): 1, (1, "BSD-3-Clause"): 1, (2, "MIT with warranty"): 1, (3, "MIT notice"): 0.8, (4, "Apache-2.0 header"): 1, (5, "ISC"): 1}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def test_pseudonyms_keep_format_and_links(spark):
    card, other = "4785380592391139", "4785 3805 9239 1139"
    texts = {
        1: f"pay {card} or {other} now", 2: f"again {card}$$$", 3: "bad 4785380592391138 stays 12345", 4: None, 5: "", 6: "none \u0001 here \u0002 5",
        7: "born 2024-02-29, not 2023-02-29; 31/12/1999", 8: "at 10.0.0.255 and 300.1.1.1 v1.2.3", 9: "mail Ann.Lee7@mail.example.com, +1 (743) 555-3824", 10: "again ann@x.org Ann.Lee7@mail.example.com", 11: "id 123-45-6789", 12: ("pad " * 5000) + card,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n_found", F.lit("x")).withColumn("_x", F.lit(1))
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(df, "k1").collect()}
    got = {k: r["text"] for k, r in out.items()}
    new = re.search(r"pay (\d+) or (\d{4} \d{4} \d{4} \d{4}) now", got[1])
    assert new[1] != card and new[1] == new[2].replace(" ", "") and luhn(new[1]) % 10 == 0
    assert got[2] == f"again {new[1]}$$$" and got[12].endswith(" " + new[1]) and len(got[12]) == len(texts[12])
    assert [got[k] for k in (3, 4, 5, 6)] == [texts[k] for k in (3, 4, 5, 6)]
    days = re.fullmatch(r"born (\d{4}-\d\d-\d\d), not 2023-02-29; (\d\d/\d\d/\d{4})", got[7])
    dt.date.fromisoformat(days[1])
    dt.datetime.strptime(days[2], "%d/%m/%Y")
    assert re.fullmatch(r"at \d+\.\d+\.\d+\.\d+ and 300\.1\.1\.1 v1\.2\.3", got[8]) and "10.0.0.255" not in got[8]
    box = re.search(r"mail (\w+\.\w+)@mail\.example\.com", got[9])[1]
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d", box) and box in got[10] and "ann@" not in got[10]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}$", got[9]) and "555-3824" not in got[9]
    assert re.fullmatch(r"id \d{3}-\d\d-\d{4}", got[11]) and got[11] != texts[11]
    assert out[3]["n_replaced"] == 0 and out[1]["n_replaced"] == 2
    again = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(df, "k1").collect()}
    second = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(df, "k2").collect()}
    assert again == got and second[1] != got[1]
    assert pseudonyms.pseudonymise(df.limit(0), "k1").count() == 0


def plain_feistel(v, a, b, key, tag, back=False):
    left, right = divmod(v, b)
    for i in range(8)[:: -1 if back else 1]:
        f = int(hmac.new(key.encode(), f"{tag}|{i}|{left if i % 2 else right}".encode(), hashlib.sha256).hexdigest()[:13], 16) * (-1 if back else 1)
        left, right = (left, (right + f) % b) if i % 2 else ((left + f) % a, right)
    return left * b + right


def plain_digits(d, key, tag, back=False):
    half = len(d) // 2
    return str(plain_feistel(int(d), 10 ** (len(d) - half), 10**half, key, f"{tag}{len(d)}", back)).zfill(len(d))


def plain_date(day, key, back=False, late=False):
    first = dt.date(1900, 1, 1)
    n = (day - first).days
    while True:
        n = plain_feistel(n, 229, 319, key, "date late" if late else "date", back)
        if n < 73049 and (not late or (first + dt.timedelta(n)).day > 12):
            return first + dt.timedelta(n)


def plain_box(v, key):
    """The mail box that a pseudonym was made of."""
    spelt, domain = v.split("@")
    box = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in spelt)
    half = max(len(box) // 2, 1)
    left, right = box[:half], box[half:]
    for i in range(8)[::-1]:
        part, other = (right, left) if i % 2 else (left, right)
        pad = hmac.new(key.encode(), f"email|{i}|{other}|{domain.lower()}|{len(box)}".encode(), hashlib.sha512).hexdigest()
        out = ""
        for at, c in enumerate(part):
            f = int(pad[at % 32 * 4 :][:4], 16)
            base, n = next(((ord(a), ord(b) - ord(a) + 1) for a, b in ["09", *pseudonyms.ALPHABETS] if a <= c <= b), (ord(c), 1))
            out += chr(base + (ord(c) - base - f) % n)
        left, right = (left, out) if i % 2 else (out, right)
    return "".join(c.upper() if "A" <= s <= "Z" else c for s, c in zip(spelt, left + right)) + "@" + domain


def test_pseudonyms_of_the_same_person_are_linked(spark):
    phones = ["1-743-555-3824", "1 (743) 555-3824", "743-555-3824", "+1 743 555 3824", "1.743.555.3824"]
    trunk = ["+44 (0)20 7946 0958", "+442079460958", "+44 20 7946 0958"]
    boxes = ["Ivan.Petrov@example.com", "ivan.petrov@example.com", "IVAN.PETROV@Example.com", "O'Brien@x.com", "ab" + "_" * 40 + "@x.museum", "x@y." + "a" * 40]
    texts = phones + trunk + boxes
    rows = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    got = [r["text"] for r in rows]
    assert all(r["n_found"] == r["n_replaced"] == 1 for r in rows) and all(a != b for a, b in zip(texts, got))
    assert len({re.sub(r"\D", "", t)[-10:] for t in got[:5]}) == 1 and all(t.startswith(("1", "7", "+1")) or t[:3].isdigit() for t in got[:5])
    assert got[0][:2] == "1-" and got[5].startswith("+44 (0)") and len({re.sub(r"\D", "", t.replace("(0)", ""))[2:] for t in got[5:8]}) == 1
    ivan = got[8].split("@")[0]
    assert [t.split("@")[0] for t in got[9:11]] == [ivan.lower(), ivan.upper()] and ivan[0].isupper() and ivan[5].isupper() and ivan.lower() != "ivan.petrov"
    assert re.fullmatch(r"[A-Z]'[A-Z][a-z]{4}@x\.com", got[11])


def test_without_a_key_the_session_draws_one(spark):
    before = spark.conf.get("spark.tidemark.pseudonym.key", None)
    try:
        spark.conf.unset("spark.tidemark.pseudonym.key")
        key = pseudonyms.secret(spark)
        assert len(key) == 64 and pseudonyms.secret(spark) == key
        spark.conf.unset("spark.tidemark.pseudonym.key")
        assert pseudonyms.secret(spark) != key
        spark.conf.set("spark.tidemark.pseudonym.key", "own")
        assert pseudonyms.secret(spark) == "own"
    finally:
        spark.conf.unset("spark.tidemark.pseudonym.key")
        if before:
            spark.conf.set("spark.tidemark.pseudonym.key", before)


def test_pseudonyms_equal_plain_python_and_can_be_inverted(spark):
    key, rnd = "a longer secret " * 9, random.Random(3)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    texts, undo = [], []
    short = key if len(key) <= 64 else hashlib.sha256(key.encode()).digest()
    assert hmac.new(key.encode(), b"x", hashlib.sha256).digest() == hmac.new(short, b"x", hashlib.sha256).digest()
    for _ in range(12):
        body = "4" + digits(14)
        card = body + next(c for c in "0123456789" if luhn(body + c) % 10 == 0)
        texts.append(card)
        undo.append((lambda v: plain_digits(v[:-1], key, "card", True), body))
        phone = digits(10)
        texts.append(f"({phone[:3]}) {phone[3:6]}-{phone[6:]}")
        undo.append((lambda v: plain_digits(re.sub(r"\D", "", v), key, "phone1/", True), phone))
        day = dt.date(1900, 1, 1) + dt.timedelta(rnd.randint(0, 73048))
        texts.append(day.isoformat())
        undo.append((lambda v: plain_date(dt.date.fromisoformat(v), key, True), day))
        late = dt.date(rnd.randint(1900, 2099), rnd.randint(1, 12), rnd.randint(13, 28))
        texts.append(f"{late.month}/{late.day}/{late.year}")
        undo.append((lambda v: plain_date(dt.datetime.strptime(v, "%m/%d/%Y").date(), key, True, True), late))
        ip = ".".join(str(rnd.randint(0, 255)) for _ in range(4))
        texts.append(ip)
        undo.append((lambda v: ".".join(map(str, plain_feistel(int.from_bytes(bytes(map(int, v.split(".")))), 65536, 65536, key, "ip", True).to_bytes(4))), ip))
        national = digits(9)
        texts.append(f"{national[:3]}-{national[3:5]}-{national[5:]}")
        undo.append((lambda v: plain_digits(v.replace("-", ""), key, "national", True), national))
        box = "".join(rnd.choice("abcXYZ019.'_-+é") for _ in range(rnd.randint(0, 40))) + rnd.choice("aZ7")
        box = box.lstrip(".'_-+") if rnd.random() < 0.5 else "q" + box
        texts.append(f"{box}@Mail.example.com")
        undo.append((lambda v: plain_box(v, key), f"{box}@Mail.example.com"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pseudonyms.pseudonymise(df, key).orderBy("doc_id").collect()]
    for text_, new, (f, want) in zip(texts, got, undo):
        assert f(new) == want and new != text_
    assert got[2] == plain_date(dt.date.fromisoformat(texts[2]), key).isoformat()


def test_pseudonyms_link_spellings_and_alphabets(spark):
    same = ["+1 (743) 555-3824", "+17435553824", "(743) 555-3824", "743.555.3824", "743-555-3824"]
    boxes = ["иван@пример.рф", "νίκος@x.gr", "山田@例え.jp", "김철수@x.kr", "é.ü@x.de", "a" * 90 + "@mail.example.com", "x@" + "a." * 12 + "com"]
    around = [" -ann@x.org", " _ann@x.org_", "(ann@x.org)", "end.4785380592391139", "on 1/2/1999", "on 12/31/1999 and 31/12/1999", "0.4785380592391139", "a..@x"]
    texts = same + boxes + around + [None, "", boxes[0], boxes[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("parts", "new", "_parts", "_new", "a", "b")})
    rows = pseudonyms.pseudonymise(df, "k").orderBy("doc_id").collect()
    assert set(df.columns) < set(rows[0].asDict()) and all(rows[0][c] == 1 for c in ("parts", "new", "_parts", "_new"))
    got = [r["text"] for r in rows]
    assert len({re.sub(r"\D", "", t)[-10:] for t in got[:5]}) == 1 and "7435553824" not in re.sub(r"\D", "", got[0])
    for old, new in zip(boxes, got[5:12]):
        assert new != old and len(new) == len(old) and new.split("@")[1] == old.split("@")[1]
        assert not set(zip(old.split("@")[0], new.split("@")[0])) & {(c, "@") for c in old}
    ann = got[12].strip()[1:4]
    assert ann != "ann" and got[13] == f" _{ann}@x.org_" and got[14] == f"({ann}@x.org)"
    assert got[15] != around[3] and luhn(got[15]) % 10 == 0 and re.fullmatch(r"on \d{1,2}/\d{1,2}/\d{4}", got[16]) and got[16] != around[4]
    assert re.fullmatch(r"on \d\d/\d\d/\d{4} and \d\d/\d\d/\d{4}", got[17]) and "31" not in (got[17][6:8], "") or got[17] != around[5]
    assert got[18:21] == [around[6], around[7], None] and got[21] == "" and got[22] == got[23] == got[5]
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(df, "")


@pytest.mark.parametrize("a,b", [(229, 319), (10, 10), (100, 1000)])
def test_feistel_is_a_permutation(spark, a, b):
    n = a * b
    p = spark.range(n).select(pseudonyms.feistel(F.col("id"), F.lit(a), F.lit(b), "k", F.lit("t")).alias("p")).agg(F.min("p"), F.max("p"), F.countDistinct("p")).first()
    assert tuple(p) == (0, n - 1, n)


def test_row_helpers():
    v, o = np.array([3, 1, 2], np.uint32), np.array([0, 2, 2, 3])
    assert text.row_minima(v, o).tolist() == [1, 2**32 - 1, 2] and text.row_sums(v.astype(np.int64), o).tolist() == [4, 0, 2]
