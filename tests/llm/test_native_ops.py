import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import chat, line_dedup, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(covered)


def test_quality_counts(spark, docs):
    base = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while."
    texts = [None, "", " \t\n\x0b", base, base + "\n" + base, "a " * 40, "\n".join([base, "  ", base, "x"]), "tab\tand\x0cfeed\r\nword " * 9, "#*$%&|<> é ü 漢字 words", "one two three four five six seven eight nine " * 3]
    got = {r["doc_id"]: r for r in quality.assess(docs(texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated(words))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(words) < 20 or 100 * want[4] > 30 * len(words))


def test_quality_lines(spark, docs):
    prose = "It was a long day, and nobody said much about it until the evening came at last.\n" * 1 + "Then the lamps were lit, one by one, and the street looked warm again to all of us."
    menu = "Home | About | News | Contact | Help"
    got = {r["doc_id"]: r for r in quality.assess(docs([prose, prose + "\n" + menu, "\n".join([menu] * 8), prose + "\nSkip to content"])).collect()}
    assert got[0]["kept"] and got[0]["clean_text"] == prose and got[1]["clean_text"] == prose and got[1]["kept"]
    assert not got[2]["kept"] and got[3]["clean_text"] == prose


def test_quality_empty_and_clashing(spark, docs):
    df = docs(["word " * 30 + "."]).withColumn("kept", F.lit("mine")).withColumn("_words", F.lit(1)).withColumn("extra", F.lit(2))
    assert quality.assess(df).first()["extra"] == 2
    assert quality.assess(docs([]).limit(0)).count() == 0


CONTROL = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<|", "<<||", "a\\<|b", "", None, "plain\ntext <|nl|>"]


def test_chat_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "<|im_end|>\nodd"][i % 3], t) for i, t in enumerate(CONTROL)] + [(2, None, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text")))
    done = chat.format_conversations(df).withColumns({"t": chat.read_turns(F.col("formatted")), "l": chat.read_loss(F.col("blocks"), F.col("loss_spans"))})
    got = {r["conv_id"]: r for r in done.collect()}
    assert [(x["role"], x["text"]) for x in got[1]["t"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1]["l"] == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(x["role"], x["text"]) for x in got[2]["t"]] == [("", "")] and got[None]["l"] == "xx"
    assert got[1]["formatted"].count("<|im_start|>") == len(CONTROL)


def test_chat_parts(spark):
    part = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
    content = [("text", "see ", None, None, None, None, None), ("image", None, "u1", 56, 29, None, None), ("audio", None, "u2", None, None, 1.01, None), ("document", None, "u3", None, None, None, 2), ("zip", None, "u4", None, None, None, None), ("image", None, "u5", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{part}>")
    r = chat.format_conversations(df).first()
    assert "see <|image|><|audio|><|document|><|file|><|image|>" in r["formatted"]
    assert [(a["ordinal"], a["type"], a["uri"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "u1", 4), (1, "audio", "u2", 26), (2, "document", "u3", 1024), (3, "file", "u4", 0), (4, "image", "u5", 256)]


def waterfill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mixing(spark, docs):
    texts = ["w " * (1 + (i * 37) % 90) for i in range(300)] + [None, "", "   "]
    names = {i: [None, "b", "a", "é", "B", "big"][min(5, i % 9)] for i in range(len(texts))}
    df = docs(texts, names)
    got = mixing.mix(df).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        size = len(WORD.findall(texts[r["doc_id"]] or ""))
        assert r["size"] == size and 0 <= r["taken"] <= 2 * size
        assert [c["words"] for c in r["copies"]] == sorted((c["words"] for c in r["copies"]), reverse=True) or r["taken"] < 2 * size
        s = names[r["doc_id"]]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + size, taken.get(s, 0) + r["taken"], r["target"]
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
    want = waterfill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == round(target[s])
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


@pytest.mark.parametrize("knots", [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (0.3, 2.0), (1.0, 0.1)]])
def test_schedule_inverse(spark, knots):
    shares = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    k = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in knots))
    at = [r[0] for r in df.select(mixing.due(F.col("s"), k)).collect()]

    def area(t):
        total = 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
            x = min(max(t, t0), t1)
            w = a + (b - a) * (x - t0) / (t1 - t0)
            total += (x - t0) * (a + w) / 2
        return total

    for s, t in zip(shares, at, strict=True):
        assert area(t) / area(1.0) == pytest.approx(s, abs=1e-9)


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def brute_lines(texts):
    """Removed line numbers by document."""
    where = {}
    for d, t in enumerate(texts):
        for n, raw in enumerate((t or "").split("\n")):
            if WORD.search(raw):
                where.setdefault(raw.strip(" "), []).append((d, n))
    lines = list(where)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            p, q = shingles(a), shingles(b)
            if 100 * len(p & q) >= 80 * len(p | q):
                root[find(a)] = find(b)
    groups = {}
    for x in lines:
        groups.setdefault(find(x), []).extend(where[x])
    return {at for g in groups.values() for at in sorted(g)[1:]}


def test_line_dedup(spark, docs):
    import random

    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "mo", "ti", "sha") for b in ("re", "lon", "ki") for c in ("n", "sta", "ver")]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 30))) + "." for _ in range(40)]
    near = [x.replace(x.split()[7], "changed", 1) for x in lines[:15]]
    texts = ["\n".join(rng.sample(lines + near, 6)) for _ in range(30)] + [None, "", "\n \n", lines[0], lines[0] + "\n" + lines[0], "one\ntwo\none"]
    gone = brute_lines(texts)
    for r in line_dedup.dedup_lines(docs(texts)).collect():
        t = texts[r["doc_id"]] or ""
        want = "\n".join(x for n, x in enumerate(t.split("\n")) if (r["doc_id"], n) not in gone)
        assert r["clean_text"] == want, r["doc_id"]


def test_line_dedup_signs_whole_lines(spark, docs):
    """Lines without blanks, tab-separated and short ones, edits at any place."""
    import random

    rng = random.Random(11)
    letters, han = "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0x4E00, 0x4F00)]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))

    def edited(line, n):
        x = list(line)
        for i in rng.sample([i for i, c in enumerate(x) if c not in " \t"], n):
            x[i] = "#"
        return "".join(x)

    lines = ["https://" + "/".join(word(9) for _ in range(9)) for _ in range(15)]
    lines += ["".join(rng.choice(han) for _ in range(70)) for _ in range(15)]
    lines += ["\t".join(word(6) for _ in range(12)) for _ in range(15)]
    lines += [" ".join(word(rng.randint(5, 20)) for _ in range(14)) for _ in range(40)]
    near = [edited(x, 1) for x in lines] + ["#" + x[1:] for x in lines] + [edited(x, 3) for x in lines[45:]]
    short = [word(rng.randint(1, 9)) for _ in range(20)] + [word(20) for _ in range(20)]
    near += [x[:-1] + "#" for x in short] + [x + "#" for x in short]
    texts = [*lines, *short, *near]
    gone = {d for d, _ in brute_lines(texts)}
    assert len(gone) > 150
    assert {r["doc_id"] for r in line_dedup.dedup_lines(docs(texts)).collect() if r["n_removed"]} == gone


def test_line_dedup_edges(spark, docs):
    assert line_dedup.dedup_lines(docs([]).limit(0)).count() == 0
    same = line_dedup.dedup_lines(docs([(1, "a line of words"), (1, "a line of words"), (None, "a line of words")])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in same) == [(False, 0), (False, 0), (True, 1)]
    assert hashlib.sha256(b"").hexdigest()


def test_mixing_with_clashing_columns(spark):
    """Columns by the names that the operator works with neither crash nor change a mix."""
    rows = spark.createDataFrame([(i, "some words of a text " * (i % 5 + 1), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(rows).collect()}
    clash = rows
    for name in ("place", "size", "position", "copies", "source_rows", *mixing.INNER):
        clash = clash.withColumn(name, rows["doc_id"])
    got = mixing.mix(clash)
    assert "place" in got.columns and not set(mixing.INNER) & set(got.columns)
    assert {r["doc_id"]: r["taken"] for r in got.collect()} == plain
    assert mixing.in_order(got).count() > 0
    assert mixing.mix(rows.limit(0)).count() == 0
