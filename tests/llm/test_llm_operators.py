"""The operators of loomstead.llm against plain brute-force versions on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstead.llm import chat, decontaminate, jaccard_join, kernel, licenses, line_dedup, packing, pseudonyms, quality_classifier, quality_rules, suffix_tree

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, rep string, label string, key string"
WS = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WS.findall(fold(t))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x", None, "k") for i, t in rows], DOCS)


def corpus():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows = [(0, None), (1, ""), (2, "  \t\n "), (3, "One"), (4, "one"), (5, "a b c d e"), (6, "A b  c\nd e"), (None, "null id text of some words here"), (-7, "x\n\nx\n")]
    for i in range(10, 130):
        t = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 30, 90, 200]))]
        rows.append((i, " ".join(t) + ("\n" + passage if i % 3 == 0 else "") + ("\nShared Line of text \n" if i % 4 == 0 else "")))
    base = [rnd.choice(vocabulary) for _ in range(180)]
    for i in range(200, 240):
        t = list(base)
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(t)))
    rows += [(300, rows[20][1]), (301, rows[20][1]), (302, "Café CAFÉ " * 4000), (303, "café cafÉ " * 4000)]
    rows += [rows[30], rows[31]]
    return rows


def shingles(t):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_kernel_hashes_words_of_whole_texts():
    column = pa.array(["a b", None, "B  a", "", "ü a\n"])
    seen = []
    for _, _, data, offsets in kernel.slices(column, 4):
        h, begin, _, _ = kernel.word_hashes(data, offsets)
        seen += [h[begin[t] : begin[t + 1]].tolist() for t in range(len(begin) - 1)]
    a, b = seen[0]
    assert seen[1] == seen[3] == [] and seen[2] == [b, a] and seen[4][1] == a and seen[4][0] not in (a, b)
    table = kernel.Lookup(np.array([5, 9, 1 << 63], np.uint64))
    assert table.find(np.array([9, 7, 1 << 63, 5], np.uint64)).tolist() == [1, -1, 2, 0]


def test_jaccard_join_matches_all_pairs(spark):
    rows = corpus()
    got = {}
    result = jaccard_join.jaccard_join(frame(spark, rows)).collect()
    assert len(result) == len(rows)
    for r in result:
        got[r.doc_id] = (r.n_shingles, r.component_id)
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(links, ids)
    assert len(set(want.values())) < len(ids) - 30
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), want[i]) for i in ids}
    assert got[None] == (3, None)


def test_jaccard_join_finds_chains_across_a_shared_leader(spark):
    rnd = random.Random(9)
    t = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):  # each links with its neighbours only, all share keys
        rows.append((i, " ".join(t)))
        for _ in range(6):
            t[rnd.randrange(len(t))] = f"x{rnd.random()}"
    sets = {i: shingles(x) for i, x in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    assert got == roots(links, sets)


def test_keep_first_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words here"), (None, "a b c d e f"), (1, "a b c d e f")]
    kept = jaccard_join.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3]


def lines_of(rows):
    docs = defaultdict(set)
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                docs[key(x)].add(i)
    out = []
    for i, t in rows:
        x = (t or "").split("\n")
        stay = [y for y in x if i is None or len(key(y)) < 10 or len(docs[key(y)]) < 2 or min(docs[key(y)]) == i]
        out.append((i, len(x), len(x) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(spark):
    rows = [*corpus(), (400, "Only Line Shared By Two"), (401, " only line shared by two\t"), (401, " only line shared by two\t")]
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in lines_of(rows))
    assert sum(d for _, _, d, _ in lines_of(rows)) > 40
    assert Counter(map(tuple, line_dedup.line_report(frame(spark, rows)).collect())) == want
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == Counter((i, t, len(t)) for i, _, _, t in lines_of(rows))


def test_chat_formatting_reads_back(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rnd = random.Random(5)
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 0, None, None), (2, 0, "assistant", ""), (3, 2, "assistant", "<||x <|<"), (3, None, "user", "|> <"), (3, 2, "assistant", "<||x <|<"), (4, 0, "us\ner<|n|>", "x\n\ny\n"), (6, 0, "system", "only")]
    rows += [(5, k, ("system", "user", "assistant")[0 if k == 0 else 1 + k % 2], " ".join("wörd" for _ in range(rnd.choice([0, 3, 100, 900])))) for k in range(60)]
    conv = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, win string")
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in chat.chat_report(conv).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = chat.format_chats(conv).where("conv_id = 5").orderBy("window_id").collect()
    assert len(windows) > 5 and all(w.text.startswith("<|im_start|>system\n") for w in windows)
    assert any(w.n_repeated > 1 for w in windows[1:])
    for w in windows:  # in budget, but for single long turns
        parts = w.text.split("<|im_start|>")[1:]
        assert len(parts) - w.n_repeated == 1 or sum(len(words(p)) for p in parts) <= chat.BUDGET
    assert chat.chat_report(conv.limit(0)).count() == 0


def test_license_scan(spark):
    rows = [*corpus(), (500, "x MIT License\nmit\nlicense y"), (501, "Released under the MIT License."), (502, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (503, "the license of the public domain"), (504, "Apache-License, apache LICENSE"), (505, "Licensed under the Apache License, Version 2.0."), (505, "Licensed under the Apache License, Version 2.0.")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in rows:
        w = word.findall(fold(t))
        base = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        best, labels = 0.0, {x for _, x in base}
        for line in (t or "").split("\n"):
            b = set(word.findall(fold(line)))
            for label, wording in licenses.TEMPLATES:
                s = set(wording.split())
                if len(b & s) >= math.ceil(0.8 * len(s) - 1e-9):
                    best = max(best, len(b & s) / len(s))
                    labels.add(label)
        at = [k for k, _ in base]
        want.append((i, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), max(best, 1.0 if base else 0.0)))
    got = [tuple(r) for r in licenses.license_report(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(want)
    assert {r[0]: r[6] for r in got}[502] == "cc-by-nc,gpl"


def test_quality_statistics(spark):
    rows = [*corpus(), (600, "#a <b> [c] 100% | & x"), (601, "a b c d e f g h\n" * 3 + "\n\n  \n"), (602, " ".join("abcdefghijkl") + " " + " ".join("abcdefgh"))]
    want = []
    for i, t in rows:
        t = t or ""
        w, seen, dup = WS.findall(t), set(), 0
        for line in t.split("\n"):
            if WS.search(line):
                dup += line in seen
                seen.add(line)
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)))
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0, "clash") for i in range(10, 130)], "doc_id long, quality int, toxic int, n string")
    got = quality_rules.quality_report(frame(spark, rows), labels).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    kept = quality_rules.keep_good(frame(spark, rows), labels)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules.quality_report(frame(spark, rows), labels.limit(0)).where("kept = base_failed").count() == 0


def test_quality_operators_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.select("doc_id", "quality")
    r = quality_rules.quality_report(docs, labels).join(known, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
    kept = {x[0]: x[1] for x in r}
    assert kept[0] < 0.1 and kept[1] > 0.95
    r = quality_classifier.quality_scores(docs, labels)
    assert r.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    held = r.join(known, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(x.predicted == x.quality for x in held) / len(held) > 0.93
    fold = {x.doc_id: x.held_out for x in r.collect()}
    assert all(fold[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in fold)


def test_tiles_are_greedy_and_longest_first():
    a = np.array([1, 2, 3, 4, 5, 9, 6, 7, 8, 1, 2, 3], np.uint64)
    b = np.array([6, 7, 8, 1, 2, 3, 4, 5], np.uint64)
    assert decontaminate.tile(a, b, 2) == [(6, 6, 0), (2, 3, 6)]
    assert decontaminate.tile(a, b, 7) == []


def test_decontamination_catches_reordered_passages(spark):
    rnd = random.Random(2)
    make = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 40)}é" for _ in range(n)]
    item, other = make(40), make(9)
    moved = item[24:] + make(5) + item[12:24] + make(5) + item[:12]
    rows = [(1, " ".join(make(50) + moved)), (2, " ".join(item[:15] + make(60))), (3, " ".join(item).upper() + "!"), (4, None), (5, ""), (6, " ".join(make(300))), (7, " ".join([*make(20), *other])), (8, "tiny"), (3, " ".join(item).upper() + "!"), (9, "one two three")]
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other)), (2, None), (3, ""), (4, "two three")], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), benchmark)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 0), (3, 0), (3, 0), (7, 1), (9, 4)]
    assert {r.n_tiles for r in got.where("doc_id = 1").collect()} == {3}
    kept = decontaminate.drop_contaminated(frame(spark, rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8]
    assert decontaminate.contamination(frame(spark, rows), benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, rows), benchmark.limit(0)).count() == len(rows)


def test_shortest_pack_first_holds_every_piece():
    rnd = random.Random(1)
    histogram = {n: rnd.randint(1, 50) for n in rnd.sample(range(1, 2049), 300)}
    patterns = packing.shortest_pack_first(histogram)
    held = Counter()
    for count, pattern in patterns:
        assert sum(pattern) <= 2048
        held.update({k: v * count for k, v in Counter(pattern).items()})
    assert held == Counter(histogram)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(), (700, "Don't STOP... <|endoftext|> it's 3.14 naïve J̌ J̌ x y Ünï"), (701, "!!! ??? a.b.c, (d)"), (702, "İ CAFÉ. ÉTÉ,  z")]
    tokenizer = Tokenizer.from_file(packing._default_tokenizer())
    got = packing.pack(frame(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[i, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.25 * sum(r.length for r in got) / 2048 + 1
    assert packing.pack(frame(spark, [])).count() == 0


# A plain version of the suffix tree, over dictionaries.
def plain_tree(train, p_min):
    end, n = "</>", Counter()
    seqs = [[*words(t), end] for t in train]
    for s in seqs:
        n.update(s)
    total, size = sum(n.values()), len(n)
    least = max(suffix_tree.LEAST, p_min * total)
    frequent = {w for w, c in n.items() if c >= least}
    root = lambda w: (n[w] + 0.5) / (total + 0.5 * (size + 1))
    two, three = Counter(), Counter()
    for s in seqs:
        two.update((a, b) for a, b in zip([end, *s], s) if a in frequent and b in frequent)
    two = {k: c for k, c in two.items() if c >= least}
    for s in seqs:
        three.update((a, b, c) for a, b, c in zip([end, *s], s, s[1:]) if (a, b) in two and c in frequent)
    three = {k: c for k, c in three.items() if c >= least}

    def grown(counts, contexts, below):
        states = {}
        by = defaultdict(dict)
        for k, c in counts.items():
            by[k[:-1]][k[-1]] = c
        for s, nexts in by.items():
            weight = 1 - sum(c - suffix_tree.DISCOUNT for c in nexts.values()) / contexts[s]
            p = {w: (c - suffix_tree.DISCOUNT) / contexts[s] + weight * below(s, w) for w, c in nexts.items()}
            gain = sum(c * math.log(p[w] / below(s, w)) for w, c in nexts.items()) + (contexts[s] - sum(nexts.values())) * math.log(max(weight, 1e-300))
            if gain / contexts[s] >= suffix_tree.DIVERGENCE:
                states[s] = (weight, p)
        return states

    one = grown(two, {(w,): c for w, c in n.items()}, lambda s, w: root(w))

    def after(a, w):
        weight, p = one.get((a,), (1.0, {}))
        return p.get(w, weight * root(w))

    deep = grown(three, two, lambda s, w: after(s[1], w))

    def prob(a, b, w):
        weight, p = deep.get((a, b), (1.0, {}))
        return p.get(w, weight * after(b, w))

    return n, total, root, prob, one, deep, end


@pytest.mark.parametrize("p_min", [1e-6, 0.002])
def test_suffix_tree_scores(spark, p_min):
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    n, total, root, prob, one, deep, end = plain_tree([t for i, t in rows if not held(i)], p_min)
    assert one and (deep or p_min > 1e-3)
    want = []
    for i, t in rows:
        s = [*words(t), end]
        a, b, base, score = None, end, 0.0, 0.0
        for w in s:
            base += math.log10(root(w))
            score += math.log10(prob(a, b, w))
            a, b = b, w
        want.append((i if i is not None else 10**9, held(i), len(s), sum(n[w] > 0 for w in s), total, base, score))
    got = [(10**9 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in suffix_tree.score_texts(frame(spark, rows), p_min).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    unseen = 0.5 / (total + 0.5 * (len(n) + 1))
    for s, (weight, _) in list(deep.items())[:20]:  # a distribution: all words seen and one unseen
        a, b = s
        mass = sum(prob(a, b, w) for w in n) + prob(a, b, "\0never")
        assert mass == pytest.approx(1, abs=1e-9)
    assert unseen > 0 and suffix_tree.score_texts(frame(spark, [])).count() == 0


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_permuted(value, key, kind):
    half = len(value) // 2
    left, right = value[:half], value[half:]

    def shifted(part, digest):
        out = ""
        for i, c in enumerate(part):
            by = int(digest[4 * i : 4 * i + 4], 16)
            low, n = (48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26)
            out += chr((ord(c) - low + by) % n + low)
        return out

    for r in range(pseudonyms.ROUNDS):
        digest = hashlib.sha512(f"{key}|{kind}|{r}|{left if r % 2 else right}".encode()).hexdigest()
        left, right = (left, shifted(right, digest)) if r % 2 else (shifted(left, digest), right)
    return left + right


def test_pseudonyms_keep_format_and_links(spark):
    valid = ["4111111111111111", "4111 1111 1111 1111", "378282246310005", "und.34@mail7.example.com", "+1 (017) 555-7713", "555-123-4567", "2024-02-29", "29/02/2024", "2/29/2024", "3.7.1999", "123-45-6789", "97.51.17.173", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"]
    invalid = ["4111111111111112", "2023-02-29", "666-45-6789", "256.1.1.1", "DE88370400440532013000", "12345", "v1.2.3", "abc", "10:30", "1.2.3.4.5"]
    rows = [(1, " ".join(valid)), (2, f"x {valid[0]}, y ({valid[3]}).\n{valid[4]}"), (3, " ".join(invalid)), (4, None), (5, ""), (6, "<" + valid[0] + ">"), (6, "<" + valid[0] + ">")]
    out = {r.doc_id: r for r in pseudonyms.pseudonym_report(frame(spark, rows), "k").collect()}
    text = out[1].text
    got = []
    m = spark.createDataFrame([(v,) for v in valid], "m string").select("m", pseudonyms.pseudonym(F.col("m"), "k")).collect()
    new = {r[0]: r[1] for r in m}
    assert text == " ".join(new[v] for v in valid) and out[1].n_replaced == len(valid)
    assert out[2].text == f"x {new[valid[0]]}, y ({new[valid[3]]}).\n{new[valid[4]]}" and out[2].n_replaced == 3
    assert out[3].text == rows[2][1] and out[3].n_replaced == 0 and out[4].text is None and out[5].text == "" and out[6].text == f"<{new[valid[0]]}>"
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    for v in valid:
        assert new[v] != v
        if v not in ("2/29/2024", "3.7.1999", valid[-1], "97.51.17.173"):
            assert shape(new[v]) == shape(v), (v, new[v])
    assert luhn(new[valid[0]]) and luhn(new[valid[2]]) and new[valid[1]].replace(" ", "") == new[valid[0]]
    assert new["DE89 3704 0044 0532 0130 00"].replace(" ", "") == new["DE89370400440532013000"]
    body = plain_permuted(valid[0][:-1], "k", "card")
    assert new[valid[0]][:-1] == body
    d1, d2 = new["2024-02-29"].split("-"), new["29/02/2024"].split("/")
    assert d1 == d2[::-1] and not got


def test_number_permutation_is_one_to_one(spark):
    rows = spark.range(189 * 73).select(pseudonyms.permuted_number(F.col("id"), 189, 73, "k", "t").alias("p"))
    r = rows.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(r) == (189 * 73, 0, 189 * 73 - 1)


@pytest.mark.parametrize("name", ["jaccard", "lines", "licenses", "quality", "classifier", "pseudonyms"])
def test_empty_tables(spark, name):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    run = {
        "jaccard": lambda: jaccard_join.jaccard_join(docs), "lines": lambda: line_dedup.line_report(docs), "licenses": lambda: licenses.license_report(docs),
        "quality": lambda: quality_rules.quality_report(docs, labels), "classifier": lambda: quality_classifier.quality_scores(docs, labels), "pseudonyms": lambda: pseudonyms.pseudonym_report(docs),
    }
    assert run[name]().count() == 0


def test_classifier_without_labels_and_with_nulls(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_classifier.quality_scores(frame(spark, [(1, None), (None, "x y"), (2, "")]), labels).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == 3


def test_pipeline_stages_fit_together(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.select("doc_id").distinct().count() == before
