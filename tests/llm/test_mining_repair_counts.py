"""Hard negatives, conversation repair and token counts against plain versions, and on odd input."""

import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import pytest

from windrift.llm import negatives, registry, repair, token_counts

BLANK = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


# Hard negatives.
def plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) of rows (id, label, integers), all pairs by Python's integers."""
    out = []
    for k, (anchor, label, v) in enumerate(rows):
        if anchor % negatives.EVERY:
            continue
        scored = sorted(((-sum(a * b for a, b in itertools.zip_longest(v, w, fillvalue=0)), other, lab) for i, (other, lab, w) in enumerate(rows) if i != k), key=lambda x: x[:2])
        for p, positive in [(-s, o) for s, o, lab in scored if lab == label][:5]:
            fit = [(-s, o) for s, o, lab in scored if lab != label and 80 * p <= 100 * -s <= 100 * p][:5]
            out += [(anchor, positive, r + 1, o, p, s) for r, (s, o) in enumerate(fit)]
    return sorted(out)


def test_negatives_match_sql(matches):
    matches(registry.QUERIES["op11_negatives"], registry.ORACLE_SQL["op11_negatives"])


def test_negatives_match_plain_version(spark):
    rnd = random.Random(5)
    rows = [(i, i % 3, [rnd.randint(-40, 60) for _ in range(30)]) for i in range(330)]
    same = [rnd.randint(0, 50) for _ in range(30)]
    rows += [(400 + i, i % 2, same) for i in range(60)]  # a third of the rows is one vector; 400 is an anchor among its copies
    rows += [(500, 1, [1]), (600, 2, []), (700, 0, [-3] * 30), (800, 7, same), (900, 1, [0] * 30)]  # short, empty, without positives, negative scores, zeros
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    want = plain_negatives(rows)
    assert len(want) > 100 and 800 not in {r[0] for r in want}
    for block in (negatives.BLOCK, 1):  # one block, and as many as there are anchors
        got = negatives.mine(df.repartition(3), block_bytes=block * 30 * 8 * 4 if block == 1 else block)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_bounds_discard_and_hold():
    rng = np.random.default_rng(2)
    v = rng.integers(-150, 150, (400, 64)) * 2 * 0.85 ** np.arange(64)
    v = np.floor(v).astype(np.int64)
    _, q = np.linalg.eigh((v.T @ v).astype(float))
    a, r = negatives.Rotated(v[:50], q[:, ::-1], (8, 24)), negatives.Rotated(v, q[:, ::-1], (8, 24))
    exact = v[:50] @ v.T
    least = np.sort(exact, axis=1)[:, -6]
    most = np.sort(exact, axis=1)[:, -2]
    i, j, score = negatives.survivors(a, r, (8, 24), np.ones((50, 400), bool), least, most)
    want = np.nonzero((exact >= least[:, None]) & (exact <= most[:, None]))
    assert (i == want[0]).all() and (j == want[1]).all() and (score == exact[want]).all()
    part = a.turned[:, :8] @ r.turned[:, :8].T
    kept = part + np.outer(a.left[8], r.left[8]) >= least[:, None]
    assert kept.mean() < 0.5 and (abs(exact - part) <= np.outer(a.left[8], r.left[8]) + 1e-3).all()


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, 1, [0.5, 0.25], "x"), (None, 1, [0.5, 0.5], "x"), (1, None, [1.0, 1.0], "x"), (2, 1, None, "x"), (3, 1, [nan, 1.0], "x"), (4, 1, [inf, 1.0], "x"), (5, 1, [None, 1.0], "x"), (6, 1, [0.5, 0.5], "x"), (6, 1, [0.5, 0.5], "x"), (8, 2, [0.5, 0.3], "x"), (8, 2, [0.5, 0.3], "x"), (9, 2, [1e12, 0.0], "x"), (200, 3, [0.1, 0.1], "x")]
    table = spark.createDataFrame(odd, "vec_id long, label int, embedding array<double>, uid string")
    got = sorted(tuple(r) for r in negatives.mine(negatives.vectors(table)).collect())
    kept = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v, _ in odd if None not in (i, lab, v) and all(x is not None and np.isfinite(x) and abs(x) < 1e5 for x in v)]
    assert len(kept) == 6 and got == plain_negatives(kept) and len(got) == 4
    assert negatives.mine(negatives.vectors(table.limit(0))).collect() == []
    assert negatives.mine(negatives.vectors(table.where("vec_id % 100 > 0"))).collect() == []


# Conversation repair.
def cheapest(rows):
    """(cost, edits) of rows (initial, fault), by best-first search over whole strings."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, edits
        if (edits, i, state) in seen:
            continue
        seen.add((edits, i, state))
        go = lambda c, e, n, role: heapq.heappush(heap, (cost + c, edits + e, n, STEP[state, role])) if (state, role) in STEP else None
        for role in "ua":
            go(2, "I", i, role)
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state))
            if fault != "delete":
                late = fault == "truncated"
                go(late, "K", i + 1, role)
                for new in "ua":
                    go(2 + late, "R", i + 1, new)


def plain_repair(table):
    """The contract's columns of rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, signature, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            body = text.rstrip(BLANK)
            fault = "blank" if not body.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
            seen.add((role, text))
            if fault != "none":
                count[fault] += 1
            signature.append((role[:1], "delete" if fault in ("blank", "duplicate") else fault))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit = cheapest(signature)
        lines, state, at = [], 0, 0
        for edit in audit:
            role = "uuau"[state]
            if edit in "KRD":
                _, own, text = rows[at]
                at += 1
            if edit == "D":
                continue
            name = own if edit == "K" else {"u": "user", "a": "assistant"}[role]
            lines.append(f"{name}:{'' if edit == 'I' else text}")
            state = STEP[state, name[0]]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_matches_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    want = plain_repair([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    got = repair.op12_repair(spark, sf).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_repair_of_odd_rows(spark):
    rnd = random.Random(8)
    texts = ["Yes.", "no", "", None, " \n ", "a ", "Why? \t", "é…", "x" * 300_000, "Go!"]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, *range(6)]), rnd.choice(["user", "assistant", "system", "tool", "", None, "User"]), rnd.choice(texts)) for _ in range(260)]
    rows += rows[:20] + [(77, None, None, None), (78, None, "user", "a."), (79, 5, "system", "only."), (80, -3, "user", "a."), (80, 9, "assistant", "b.")]
    clash = "conv_id long, turn long, role string, text string, audit string, cost string, _there string"
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], clash)
    damaged = repair.damaged(df)
    found = repair.report(damaged)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(damaged, found).collect()}
    got = {r.conv_id: (*(r[c] for c in COLUMNS[:-1]), digests[r.conv_id]) for r in found.collect()}
    assert got == plain_repair(rows)
    turns = {}
    for r in sorted(repair.repaired_turns(damaged, found).collect(), key=lambda r: (r.conv_id or -1, r.number)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() == h for c, h in digests.items())
    empty = repair.damaged(df.limit(0))
    assert repair.report(empty).count() == 0 and repair.repaired_turns(repair.checked(df), repair.report(repair.checked(df))).count() > 0


def test_trie_shares_layers_and_finds_the_cheapest():
    rnd = random.Random(3)
    letters = list(itertools.product("sua-", repair.FAULTS))
    code = lambda t: "".join(chr(65 + 3 * "sua-".index(r) + repair.FAULTS.index(f)) for r, f in t)
    signatures = {t for n in range(3) for t in itertools.product(letters, repeat=n)} | {tuple(rnd.choice(letters) for _ in range(rnd.randint(3, 6))) for _ in range(400)}
    trie = repair.Trie()
    for t in sorted(signatures, key=code):
        assert trie.repair(code(t)) == cheapest(t)
    assert trie.made == len({code(t)[:k] for t in signatures for k in range(1, len(t) + 1)})  # one layer for each node
    long = code(letters) * 20_000
    cost, audit = trie.repair(long)
    assert len(audit.replace("I", "")) == len(long) and cost == sum({"D": 3, "R": 2, "I": 2, "K": 0}[e] for e in audit) + sum(letters[i % 12][1] == "truncated" and e != "D" for i, e in enumerate(audit.replace("I", "")))


# Token counts.
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_counts_equal_library(spark, sf_dir, library):
    _, tokenizer = library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = token_counts.op13_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_counts_of_odd_texts(spark, library):
    path, tokenizer = library
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "中", "'s", "'ll", "<|endoftext|>", "<|endof", "text|>", "1", "12", "!", "😀", " ", "ab", "the ", "\0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "a" * 5000, "ab" * 3000, "<|endoftext|>", "<|endof", "text|>x", "<|endoftext|><|endoftext|>", " <|endoftext|> a", "word " * 120_000]
    df = spark.createDataFrame([(i % 7 or None, t, "x", "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, c0 string").coalesce(1)
    got = token_counts.count_tokens(df, path, limit=10)
    assert got.columns == ["doc_id", "text", "c0", "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 10), r.text
    assert token_counts.count_tokens(df.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.MergeCounter(path.replace("byte_bpe_50k", "word_bpe_49k"))


def test_least_pair_goes_first_and_leftmost_of_equals(library):
    path, tokenizer = library
    counter = token_counts.MergeCounter(path)
    for word in ("aaaaaaa", "abababab", "tththth", "eeeeer", "hehehehe", "  " * 9):
        assert counter.word(word.encode()) == len(tokenizer.model.tokenize(word.replace(" ", "Ġ")))
