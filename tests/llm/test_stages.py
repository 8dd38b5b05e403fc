"""The pipeline's stages and the quality model against plain Python."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

from leafmill.llm import quality_model
from leafmill.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", s, len(t or "")) for i, t, s in rows], COLUMNS)


def within_one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a == b or a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_the_line_stage(spark):
    import corpus_pipeline

    rng = random.Random(1)
    pool = [words(rng, rng.randint(1, 9)) for _ in range(30)]
    edit = lambda s: s[: (k := rng.randrange(len(s)))] + rng.choice("xyz") + s[k + rng.randint(0, 1) :]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), edit(rng.choice(pool)), words(rng, 6), "", "  "]) for _ in range(rng.randint(1, 5))), "s") for i in range(120)]
    rows.append((200, pool[0] if len(pool[0]) >= 20 else pool[0] * 9, "s"))
    want, seen = {}, []
    for i, text, _ in rows:
        kept = []
        for line in text.split("\n"):
            if len(line) < 20 or not any(within_one_edit(line, s) for s in seen):
                kept.append(line)
            if len(line) >= 20:
                seen.append(line)
        if len(kept) == len(text.split("\n")) or re.search(r"[^\x20\x09-\x0D]", "\n".join(kept)):
            want[i] = "\n".join(kept)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, table(spark, rows), "").collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_the_mixing_stage(spark):
    import corpus_pipeline

    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice([0, 1, 5, 20, 90])), rng.choice(["a", "b", "b", "b", None])) for i in range(90)]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    place = lambda i: hashlib.md5(f"mix{i}".encode()).hexdigest()
    queue = []
    for k, s in enumerate(sources):
        upto = 0
        for _ in range(3):
            for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (place(r[0]), count(r[1]))):
                for _ in range(count(t)):
                    upto += 1
                    queue.append((upto / weight[s], k, upto, i))
    total = sum(count(t) for _, t, _ in rows)
    taken = Counter(i for _, _, _, i in sorted(queue)[:total])
    want = Counter({(i, t): math.floor(taken[i] / count(t) + 0.5) for i, t, _ in rows if count(t)})
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, table(spark, rows), "").collect())
    assert got == +want


def test_the_packing_stage(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([1, 40, 700, 6000])), "s") for i in range(25)] + [(90, None, "s"), (91, "", "s"), (90, None, "s")]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    pieces = corpus_pipeline.pack_sequences(spark, table(spark, rows), "").collect()
    whole, sequences = {}, {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        whole.setdefault(p["doc_id"], Counter()).update(range(p["start"], p["start"] + p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    copies = Counter(i for i, _, _ in rows)
    assert whole == {i: Counter(dict.fromkeys(range(len(x)), copies[i])) for i, x in ids.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def plain_features(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars, n = sum(map(len, found)), len(found)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    grams = Counter(zip(found, found[1:], found[2:], strict=False))
    repeated = len({i + k for i, g in enumerate(zip(found, found[1:], found[2:], strict=False)) if grams[g] > 1 for k in range(3)})
    kinds = Counter(unicodedata.category(c) for c in text)
    odds = lambda some, rest: math.log((some + 0.5) / (max(rest, 0) + 0.5))
    symbols, digits = sum(text.count(c) for c in "#*$%&|<>"), sum(text.count(c) for c in "0123456789")
    return [
        math.log1p(n), math.log((chars + 1) / (n + 1)), odds(symbols, chars - symbols), odds(kinds["Lu"] + kinds["Lt"], kinds["Ll"]), odds(text.count("!"), chars),
        odds(text.count("|"), n), odds(dup, len(lines) - dup), odds(repeated, n - repeated), math.log((len(set(found)) + 1) / (math.sqrt(n) + 1)),
        odds(digits, chars), odds(sum(text.count(c) for c in ".,;:?"), chars), math.log((n + 1) / (len(lines) + 1)),
    ]


def test_quality_scores_are_those_of_a_plain_discriminant(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        good = rng.random() < 0.6
        text = ". ".join(words(rng, rng.randint(3, 12)).capitalize() for _ in range(rng.randint(1, 9)))
        if not good:
            text = rng.choice([text.upper(), text.replace(" ", "## "), "\n".join([text[:30]] * 9), text + " 123" * 30]) if rng.random() < 0.8 else text
        rows.append((i, text, int(good)))
    rows += [(500, None, 1), (501, "", 0), (502, "Ünïcödé ÀÉ ИТ привет", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    x = {i: np.array(plain_features(t)) for i, t, _ in rows}
    train = {q: np.array([x[i] for i, _, label in rows if label == q and not held(i)]) for q in (0, 1)}
    total = sum(map(len, train.values()))
    pooled = sum(((t - t.mean(0)).T @ (t - t.mean(0))) for t in train.values()) / total
    prior = (len(train[1]) + 1) / (total + 2)
    models = {}
    for q, t in train.items():
        weight = min(1.0, 0.1 + t.shape[1] / len(t))
        covariance = (1 - weight) * np.cov(t.T, bias=True) + weight * np.diag(np.diag(pooled)) + 1e-4 * np.eye(t.shape[1])
        models[q] = t.mean(0), np.linalg.inv(covariance), np.linalg.slogdet(covariance)[1]
    log_density = lambda v, q: -0.5 * ((v - models[q][0]) @ models[q][1] @ (v - models[q][0]) + models[q][2])
    for r in quality_model.classify(docs, labels).collect():
        logit = log_density(x[r["doc_id"]], 1) - log_density(x[r["doc_id"]], 0) + math.log(prior / (1 - prior))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-500, min(500, logit))))) < 1e-6, r["doc_id"]
        assert r["held_out"] == held(r["doc_id"])
