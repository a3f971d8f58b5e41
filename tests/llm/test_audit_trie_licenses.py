"""Filter audit, prefix trie and license scan: odd rows, plain forms of their contracts, and hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomcode.llm import audit, licenses, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, mask string, digest string, n long, words string, row int, blocks int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(rng):
    many = " ".join(rng.choice(["one", "Two", "three", "FOUR", "né"]) + str(rng.randint(0, 400)) for _ in range(400))
    poor = "same word " * 150
    return [None, "", "  \n", "x", many, many, many.upper(), poor, poor, many + " $", "A B", "# " + many, "a|b", many[:900], "ÀÉ " * 10, "b " * 250 + many]


def doc_rows():
    rng = random.Random(2)
    base = texts(rng)
    rows = [(i, t, ["a", None, "", "b"][i % 4]) for i, t in enumerate(base)]
    rows += [(100 + i, rng.choice(base), rng.choice(["a", "hot", "hot"])) for i in range(120)]
    rows += [(4, base[4], "hot"), (4, base[4], "a"), (None, base[4], "a"), (None, base[4], None), (None, "only without an id", "b"), (-3, base[7], "hot")]
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, 1, "m", "d", 2, "w", 3, 4) for d, t, s in rows], DOCS).repartition(3)


def label_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 220, 2)]
    return rows + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1), (6, 1, None), (6, 1, None)]


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((s or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in docs}:
        own, total = [x for x in docs if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before, m = set(order[:k]), Counter()
                for _, fails, g, t in own:
                    early = bool(fails & before)
                    m["kept"] += not early and f not in fails
                    if f in fails:
                        m["redundant" if early else "removed"] += 1
                        m["unique_fails"] += fails == {f}
                        m["good_lost"] += g and not early
                        m["toxic_lost"] += t and not early
                total[f] += m["removed"]
                out[part, "".join(order), k + 1] = m
        for (p, o, k), m in out.items():
            if p == part:
                m["shapley"] = total[o[k - 1]]
    return out


METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit(spark):
    rows, labels = doc_rows(), label_rows()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(as_docs(spark, rows), table).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in rows})
    for r in got:
        assert [r[m] for m in METRICS] == [int(want[r["part"], r["filter_order"], r["step"]][m]) for m in METRICS]
    assert audit.audit_filters(as_docs(spark, rows), table.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
    assert audit.audit_filters(as_docs(spark, rows).where("false"), table).count() == 0


def test_audit_with_filters_of_ones_own(spark):
    filters = {"x": lambda text, n, distinct: n > 3, "y": lambda text, n, distinct: text.contains("q")}
    docs = as_docs(spark, [(1, "q", "s"), (2, "a b c d q", "s"), (3, "q", "s")])
    got = {(r["filter_order"], r["step"]): (r["removed"], r["redundant"], r["kept"]) for r in audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters, "z").collect()}
    assert len(got) == 18 and got["xyz", 1] == (1, 0, 2) and got["xyz", 2] == (2, 1, 0) and got["zxy", 1] == (1, 0, 2)
    with pytest.raises(ValueError):
        audit.audit_filters(docs, docs, {"long": audit.signs})


def test_audit_of_a_very_long_text_and_one_hot_copy(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = as_docs(spark, [(0, long, "s")]).unionByName(as_docs(spark, [(1, long, "s")]).crossJoin(spark.range(3000).select(F.col("id").alias("k"))).withColumn("doc_id", F.col("k") + 1).drop("k").withColumn("text", F.lit("copy")))
    r = audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [x["removed"] for x in r] == [2999, 1, 0, 0, 0] and r[-1]["kept"] == 1


# The trie.

TURNS = "conv_id long, turn long, role string, text string, digest string, depth int, bytes string, family int, last int"


def crc(c):
    return zlib.crc32(str(c).encode()) % 9


def plain_trie(rows, heads):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 5, [])[: heads(c)] + v[heads(c) :] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        worth = (len(members) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += worth
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest())
        for k, m in nodes.items()
    )


def turn_rows():
    rng = random.Random(6)
    rows = []
    for c in [*range(-4, 60), 100, 101, 102, 1007, 10**12, 10**12 + 3]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["é", "a", "b", None, "", "long text"])))
    rows = [r for r in rows if r[0] not in (15, 20, 25)]  # families without their first conversation
    rows += [(200, t, "user", "same") for t in range(3)] + [(c, 0, "user", "hot") for c in range(300, 700)] + [(None, 1, "user", "x"), (200, 1, "user", "same"), (200, 1, "user", "other")]
    rows += [(800, t, "user", f"t{t % 50}") for t in range(700)] + [(801, t, "user", f"t{t % 50}") for t in range(650)]
    return rows


@pytest.mark.parametrize("heads", [trie.taken, trie.whole])
def test_trie(spark, heads):
    rows = turn_rows()
    table = spark.createDataFrame([(*r, "d", 1, "b", 2, 3) for r in rows], TURNS).repartition(5)
    got = trie.prefix_trie(table, heads).drop("digest").collect()
    want = plain_trie(rows, crc if heads is trie.taken else heads)
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1], r[3])) == sorted(want, key=lambda r: (r[0], r[1], r[3]))
    assert trie.prefix_trie(table.where("false"), heads).count() == 0


def test_trie_where_all_end_at_the_root(spark):
    rows = [(c, 0, "u", "x") for c in range(1, 400) if c % 5 and crc(c) > 0]  # no family has a head
    table = spark.createDataFrame([(*r, "d", 1, "b", 2, 3) for r in rows], TURNS)
    got = trie.prefix_trie(table).drop("digest").collect()
    assert list(map(tuple, got)) == plain_trie(rows, crc) and len(got) == 1 and got[0]["n_leaves"] == 1


def test_ids_of_ends_in_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 7)
    rows = [(b"k", c) for c in range(40)] + [(b"l", 3)]
    runs = list(trie.runs_of(iter(rows)))
    assert [len(r[2].split(",")) for r in runs] == [7] * 5 + [5, 1]
    assert dict(trie.hashed(iter(runs)))[b"k"] == hashlib.sha256(",".join(map(str, range(40))).encode()).hexdigest()


def test_the_explosion_is_as_long_as_all_turns(spark):
    """Chains as long as their conversations, and a comb: each conversation goes one turn further along one line than the last."""
    comb = [(c, t, "u", f"line {t}" if t < c else f"own {c}") for c in range(1, 60) for t in range(c + 1)]
    table = spark.createDataFrame([(*r, "d", 1, "b", 2, 3) for r in comb], TURNS)
    paths = trie.prefixes(table, trie.whole)
    assert paths.count() == len(comb) + 59
    assert sorted(map(tuple, trie.prefix_trie(table, trie.whole).drop("digest").collect()), key=lambda r: (r[0], r[1])) == sorted(plain_trie(comb, trie.whole), key=lambda r: (r[0], r[1]))


# Licenses.


def plain_licenses(rows, templates, phrases, threshold):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    half = max(len(cut(t.text)) for t in templates)
    sets = {t.name: set(cut(t.text)) for t in templates}
    out = []
    for d, text in rows:
        w = cut(text)
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(cut(p))] == cut(p)]
        labels, score, n = {x for _, x in places}, 0.0, 0
        for k in range(max(len(w) - half, 0) // half + 1):
            block = set(w[k * half : (k + 2) * half])
            found = [t for t in templates if len(block & sets[t.name]) >= (len(sets[t.name]) if len(sets[t.name]) < 8 else -(-len(sets[t.name]) * round(threshold * 100) // 100)) and set(cut(t.required)) <= block]
            found = [t for t in found if not any(sets[o.name] > sets[t.name] for o in found)]
            labels |= {t.label for t in found}
            score = max([score, *(len(block & sets[t.name]) / len(sets[t.name]) for t in found)])
            n += bool(found)
        at = [i for i, _ in places]
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score, n))
    return out


def license_rows():
    rng = random.Random(9)
    common = ["the", "of", "license", "under", "this", "software", "and", "public", "gnu", "x1", "né", "İstanbul", "Kelvin", "work", "3", "2", "cc", "by", "nc", "4", "0"]
    rows = [(0, None), (1, ""), (2, "---"), (3, "Under the MIT\n\nlicense UNDER the mit License; cc-by/nc cc by nc cc by nc"), (4, "under the mit license"), (5, "APACHE LICENSE, version 2.0")]
    for i in range(6, 60):
        words = rng.choices(common, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(licenses.TEMPLATES).text.split()
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(["zzz", ""])
            at = rng.randint(0, len(words))
            words[at:at] = t
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    rows += [(rows[10][0], rows[10][1]), (None, rows[3][1]), (None, None), (99, " ".join(rng.choices(common, k=30_000)) + " Licensed under CC BY-SA 4.0")]
    return rows


@pytest.mark.parametrize("threshold", [0.8, 0.55, 1.0])
def test_licenses(spark, threshold):
    rows = license_rows()
    docs = as_docs(spark, [(*r, "s") for r in rows])
    scanned = licenses.scan_licenses(docs, threshold=threshold)
    assert "Python" not in scanned._jdf.queryExecution().toString() and "Arrow" not in scanned._jdf.queryExecution().toString()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], str(r))
    assert sorted(map(tuple, scanned.collect()), key=key) == sorted(plain_licenses(rows, licenses.TEMPLATES, licenses.PHRASES, threshold), key=key)


def test_licenses_edges(spark):
    nothing = as_docs(spark, [(1, "x", "s")]).where("false")
    assert licenses.scan_licenses(nothing).count() == 0
    docs = as_docs(spark, [(1, "a b a b a", "s"), (2, "Licensed under the GNU Lesser General Public License version 3; this work is", "s")])
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs, phrases={"a b a": "x"}).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 0, 2, "x")
    assert got[2]["labels"] == "lgpl-3"  # its words hold those of gpl-3
    assert licenses.scan_licenses(docs, phrases={}).where("n_base = 0 and base_labels = ''").count() == 2
    with pytest.raises(ValueError):
        licenses.scanned(docs, [licenses.Template("t", "t", " ".join(f"w{i}" for i in range(20_001)), "")], {}, 0.8, "doc_id", "text")
