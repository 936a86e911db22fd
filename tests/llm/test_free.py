"""Quality, decontamination, chat, mixing, near copies, token counts and the pipeline: brute force, round trips, odd tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spatialcc.llm import chat, decontaminate, mixing, ngram_join, quality, token_counts, wordhash
from spatialcc.llm.components import components
from spatialcc.llm.queries import tokenizer

TOKENIZER = tokenizer()

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id bigint, shingle string, digest int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 9, "x", 1) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


ODD = [(900, ""), (901, None), (902, " \n\t "), (None, "one two"), (903, "one"), (904, "One"), (904, "One"), (905, "long " + "x" * 200_000)]


# Near copies


def brute_sets(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and rows[i][0] is not None and rows[j][0] is not None and 100 * n >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return [(k, len(sets[i]), min(x for x in least[find(i)]) if k is not None else None) for i, (k, _) in enumerate(rows)]


def near_rows(seed):
    rng = np.random.default_rng(seed)
    shared, rows = words(rng, 40), []
    for k in range(25):
        base = words(rng, int(rng.integers(5, 120))).split()
        if k % 3 == 0:
            base += shared.split()
        for c in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[rng.integers(len(own))] = words(rng, 1)
            rows.append((len(rows) * 7 % 1009, " ".join(own) if c % 2 else " \n".join(own).upper()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    rows = near_rows(seed) + ODD
    found = ngram_join.near_duplicates(table(spark, rows)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute_components(rows), key=key)


def test_near_copies_with_other_ids(spark):
    rows = near_rows(1)[:60]
    named = spark.createDataFrame([(f"d{i:05}", t) for i, t in rows], "doc_id string, text string")
    found = ngram_join.near_duplicates(named).collect()
    want = sorted((f"d{i:05}", n, f"d{c:05}") for i, n, c in brute_components(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == want


def test_near_copies_of_nothing_and_rows_that_stay(spark):
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0
    rows = near_rows(3) + ODD
    left = ngram_join.drop_near_duplicates(table(spark, rows))
    assert left.columns == table(spark, []).columns
    want = sorted(k for k, _, c in brute_components(rows) if k is not None and k == c)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == want


def test_one_large_group_with_chains(spark):
    rng = np.random.default_rng(5)
    base = words(rng, 60).split()
    rows = []
    for i in range(120):  # each copy changes one more word than the last but seven
        own = list(base)
        for k in range(i // 8):
            own[k * 4 % 60] = f"w{i // 8}x{k}" if k % 2 else f"v{k}"
        rows.append((i, " ".join(own)))
    found = ngram_join.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_components(rows))


def test_prefix_length_is_enough():
    for n in range(1, 400):
        for m in range(n, 400):
            need = -(-80 * (n + m) // 180)
            if need <= n:  # sets of these sizes can link: what isn't in the prefix is too little
                assert n - ngram_join.prefix_length(n) < need and m - ngram_join.prefix_length(m) < need


@pytest.mark.parametrize("small", [0, None])
def test_components(spark, small):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), small=small).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for a in near:
        seen, stack = {a}, [a]
        while stack:
            for b in near[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        assert found[a] == min(seen)
    assert set(found) == set(near)


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(0)
    column = pa.array([words(rng, 300), None, "", "é" * 500 + " x", words(rng, 5)], pa.string())
    want = [s.tolist() for s in wordhash.shingle_sets(column)]
    monkeypatch.setattr(wordhash, "SLICE", 64)
    assert [s.tolist() for s in wordhash.shingle_sets(column)] == want
    assert [s.tolist() for s in wordhash.shingle_sets(column.slice(2, 3))] == want[2:]


# Quality


def quality_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        text = "\n".join(words(rng, int(rng.integers(5, 30))).capitalize() + "." for _ in range(int(rng.integers(1, 8))))
        good = rng.random() < 0.7
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows(300)
    held = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = quality.classify(table(spark, rows + ODD), held).collect()
    assert len(found) == len(rows) + len(ODD)
    truth = {i: q for i, q, _ in labels}
    tested = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    # Labels of held-out rows change nothing.
    other = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, t) for i, q, t in labels]
    again = quality.classify(table(spark, rows), spark.createDataFrame(other, "doc_id bigint, quality int, toxic int")).collect()
    first = {r.doc_id: r.score for r in found}
    assert all(r.score == pytest.approx(first[r.doc_id]) for r in again)
    empty = quality.classify(table(spark, []), held)
    assert empty.count() == 0


def weights_of_labellings(score, edge):
    """Every labelling of one chain with its weight."""
    n = len(score)
    for bits in range(2**n):
        y = [(bits >> k) & 1 for k in range(n)]
        yield y, math.exp(sum(score[k] * y[k] for k in range(n)) + sum(edge[y[k], y[k + 1]] for k in range(n - 1)))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    first = np.array([0, 4, 5, 8])
    score, edge = rng.normal(size=8), rng.normal(size=(2, 2))
    got = quality.marginals(score, edge, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        every = list(weights_of_labellings(score[a:b], edge))
        good = sum(w * np.array(y) for y, w in every)
        assert np.allclose(got[a:b], good / sum(w for _, w in every))


def test_likelihood_and_its_gradient():
    rng = np.random.default_rng(2)
    first, y = np.array([0, 4, 5, 8]), rng.integers(0, 2, 8)
    score, edge = rng.normal(size=8), rng.normal(size=(2, 2))

    def brute(score, edge):
        total = 0.0
        for a, b in zip(first[:-1], first[1:], strict=True):
            every = {tuple(k): w for k, w in weights_of_labellings(score[a:b], edge)}
            total += math.log(sum(every.values())) - math.log(every[tuple(y[a:b])])
        return total

    said, by_node, by_edge = quality.likelihood(score, edge, first, y)
    assert said == pytest.approx(brute(score, edge))
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        assert by_node[k] == pytest.approx((brute(score + step, edge) - brute(score - step, edge)) / 2e-5, abs=1e-6)
    for k in range(4):
        step = np.eye(4)[k].reshape(2, 2) * 1e-5
        assert by_edge.ravel()[k] == pytest.approx((brute(score, edge + step) - brute(score, edge - step)) / 2e-5, abs=1e-6)


def brute_line(text):
    """The features of a line, one character at a time."""
    raw = text.encode()
    kind = lambda c: chr(c) if c < 128 else "é"
    is_letter = lambda c: c.isalpha() or c == "é"
    stop, shout, markup = set(".,;:"), set("!?"), set("<>{}[]|\\/=_")
    chars = [kind(c) for c in raw]
    symbol = lambda c: 33 <= ord(c) < 127 and not (c.isalnum() or c in stop | shout | markup)
    n = lambda f: sum(1 for c in chars if f(c))
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    low = [w.lower() for w in words]
    solid, per = max(n(lambda c: c not in " \t\n\v\f\r"), 1), max(len(words), 1)
    return [
        n(lambda c: "A" <= c <= "Z") / max(n(is_letter), 1), n(is_letter) / solid, n(str.isdigit) / solid,
        *(min(n(lambda c, s=s: c in s) / per, 2) for s in (stop, shout, markup)), min(n(symbol) / per, 2),
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / per, len(set(low)) / per,
        sum(symbol(kind(w[-1])) or kind(w[-1]) in shout | markup for w in words) / per,
        sum(min(len(w) / 12, 5) for w in words) / per, math.log1p(len(words)) / 5, math.log1p(len(raw)) / 8, float(not words),
    ]


def test_document_scores_equal_brute_force():
    rng = np.random.default_rng(4)
    field = quality.Field(rng.normal(size=3 * quality.OWN + 3), rng.normal(size=(2, 2)), 1.3, -0.2)
    texts = ["", "one", "A b b B!\n\n<x> $$$ 12, é\tend?", "x\n", "\n", " a|b = c.  d \r\nE;", "w " * 40 + "\nq_r"]
    got = quality.scores(field, pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        lines = text.split("\n")
        own = [brute_line(t + ("\n" if k < len(lines) - 1 else "")) for k, t in enumerate(lines)]
        zero = [0.0] * quality.OWN
        nodes = []
        for k, line in enumerate(own):
            near = line + (own[k - 1] if k else zero) + (own[k + 1] if k + 1 < len(own) else zero)
            nodes.append(np.dot(field.node, near + [float(k == 0), float(k == len(own) - 1), 1.0]))
        every = list(weights_of_labellings(nodes, field.edge))
        good = sum(w * np.array(y) for y, w in every) / sum(w for _, w in every)
        size = np.array([len((t + ("\n" if k < len(lines) - 1 else "")).encode()) for k, t in enumerate(lines)], float)
        raw = np.clip(np.average(good, weights=size if size.sum() else None), 1e-4, 1 - 1e-4)
        assert score == pytest.approx(1 / (1 + math.exp(-(field.scale * math.log(raw / (1 - raw)) + field.shift))))


# Decontamination


def test_decontamination(spark, monkeypatch):
    rng = np.random.default_rng(3)
    item = words(rng, 30)
    question = "Alice has 12 apples and gives 5 kg of them to Bob, then Alice buys 12 more pears for the party today."
    bench = spark.createDataFrame([(1, item), (2, question), (2, question), (3, "too short"), (4, None), (None, item)], "item_id bigint, text string")
    rows = [
        (1, words(rng, 50) + "\n" + item + " " + words(rng, 20)),
        (2, "Well, Carol has 30 apples and gives 7 lb of them to Dave, then Carol buys 30 more pears for the party today. Yes"),
        (3, "Well, Carol has 30 apples and gives 7 lb of them to Dave, then Erin buys 31 more pears for the party today. Yes"),
        (4, words(rng, 500)),
        (5, " ".join(item.split()[:9]) + " " + words(rng, 40)),
        (6, question + " " + item),
        *ODD,
    ]
    for together in (decontaminate.TOGETHER, 1):
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        found = {r.doc_id: r for r in decontaminate.contamination(table(spark, rows), bench).collect() if r.doc_id is not None}
        assert {k: r["items"] for k, r in found.items() if r.contaminated} == {1: "1", 2: "2", 6: "1,2"}
        assert found[2].n_reparameterised and not found[1].n_reparameterised
    left = decontaminate.drop_contaminated(table(spark, rows), bench)
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted((i or 0) for i, _ in rows if i not in (1, 2, 6))
    assert decontaminate.contamination(table(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(table(spark, []), bench).count() == 0


def test_decontamination_finds_copies_without_templates(spark):
    items = [
        "What Is The Capital Of France", "HOW MANY PLANETS, MOONS AND STARS ARE THERE?", "法国的首都是哪里？它有12座桥吗", "12 + 35 * 7 = 257, 8 + 9 - 3 = 14", "Alice, Bob, Carol, Dave, Erin, Frank",
        "Who is the king", "Does Alice have 12 apples in the box", "What is love?", "3 + 4 = ?",
    ]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id bigint, text string")
    rng = np.random.default_rng(6)
    rows = [(i, f"{words(rng, 20)} Q: {t} {words(rng, 20)}" if t[0] < "\x80" else "甲乙" + t + "丙丁") for i, t in enumerate(items, 1)]
    rows += [
        (11, "Q: Does Carol have 30 apples in the box"), (12, "so does Carol have 30 apples in the box"),  # other values, opening word inside a sentence
        (21, "what is, love"), (22, "13 + 4 and 3 4"), (23, "What are The Capitals Of France"), (24, "12 + 35 * 8 = 292, 7 + 9 - 4 = 12"),
        (25, "法国的首都在哪儿？它有很多桥"), (26, "London is the king"), (27, "Q: Can Alice have 12 plums in her box"), *ODD,
    ]
    found = {r.doc_id: r for r in decontaminate.contamination(table(spark, rows), bench).collect() if r.doc_id is not None}
    assert {k: r["items"] for k, r in found.items() if r.contaminated} == {**{i: str(i) for i in range(1, len(items) + 1)}, 11: "7", 12: "7"}
    assert all(found[i].coverage == 1 and not found[i].n_reparameterised for i in range(1, len(items) + 1)) and found[11].n_reparameterised == 1
    left = decontaminate.drop_contaminated(table(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect() if 0 < (r.doc_id or 0) < 900) == list(range(21, 28))


def questions(rng, n):
    """Word problems with slots, and how they read with some values."""
    names, units, things = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank"], ["kg", "miles", "hours", "dollars"], ["apples", "pears", "books", "coins", "stamps"]
    forms = [
        "On Monday {a} had {x} {t} and gave {y} of them to {b} before the {f} fair. How many {t} does {a} have left?",
        "A train with {x} {t} goes {y} {u} while {a} and {b} wait {z} {u} for the {f} ship. What did {a} pay for it?",
        "If {a} buys {x} {u} of {t} at the {f} shop and {b} buys {y} {u} more of the same {t}, how much do they carry home together?",
        "Every {f} morning {a} puts {x} {t} into a box that {b} empties after {y} {u}; after {z} {u} the box holds how many {t}?",
    ]
    for k in range(n):
        form, t, f = forms[k % len(forms)], things[k % len(things)], words(rng, 1)
        fill = lambda: form.format(t=t, f=f, u=rng.choice(units), **dict(zip("ab", rng.choice(names, 2, replace=False))), **dict(zip("xyz", rng.choice(np.arange(2, 99), 3, replace=False))))  # noqa: B023, E731
        yield fill(), fill()


def test_reparameterised_questions_are_found(spark):
    rng = np.random.default_rng(12)
    both = list(questions(rng, 60))
    bench = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(both)], "item_id bigint, text string")
    rows = [(i, f"{words(rng, 30)}. {b} {words(rng, 30)}") for i, (_, b) in enumerate(both)] + [(1000 + i, words(rng, 200)) for i in range(40)]
    found = {r.doc_id: r for r in decontaminate.contamination(table(spark, rows), bench).collect()}
    caught = [str(i) in found[i]["items"].split(",") and found[i].n_reparameterised > 0 for i in range(len(both))]
    assert np.mean(caught) >= 0.9
    assert not any(found[1000 + i].contaminated for i in range(40))


def test_every_window_of_an_item_passes_the_bitmap(spark):
    """Candidates of the join equal those of comparing every text with every item."""
    rng = np.random.default_rng(13)
    items = [a for a, _ in questions(rng, 8)] + [words(rng, k) for k in (1, 2, 3, 4, 7, 8, 30)] + ["12 + 35 * 7 = 257", "法国的首都是哪里？它有12座桥吗"]
    texts = [f"{words(rng, 10)} {t} {words(rng, 10)}" for t in items] + [b for _, b in questions(rng, 8)] + [t for _, t in ODD] + [" ".join(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(table(spark, list(enumerate(texts))), bench).collect()}
    index = decontaminate.benchmark_index(list(enumerate(items)))
    for i, text in enumerate(texts):
        data, at = wordhash.buffers(pa.array([text or ""], pa.large_string()))
        want = sorted(k for k, *_ in decontaminate.matches(index, decontaminate.templates(data, at), data).get(0, []))
        assert got[i] == ",".join(map(str, want))


def test_one_conflict_does_not_hide_a_copy():
    rng = np.random.default_rng(8)
    parts = [words(rng, 15) for _ in range(4)]
    item = f"{parts[0]} Alice {parts[1]} Alice {parts[2]} Alice {parts[3]}"

    def found(text):
        data, at = wordhash.buffers(pa.array([text], pa.large_string()))
        t = decontaminate.templates(data, at)
        index = decontaminate.benchmark_index([(1, item)])
        index.plain.clear()  # templates alone
        return decontaminate.matches(index, t, data).get(0, [])

    assert found(item) == [(1, 1.0, False)]
    # The third name is another one: of 63 tokens it alone is in no window that counts.
    [(_, share, changed)] = found(item[::-1].replace("ecilA", "aicilA", 1)[::-1])
    assert share == pytest.approx(62 / 63) and not changed
    [(_, share, changed)] = found(item.replace("Alice", "Carol", 2))
    assert changed and share == 1  # Carol is most frequent; the third name is the item's own
    [(_, share, changed)] = found(item.replace("Alice", "Carol", 1).replace("Alice", "Erin", 1).replace("Alice", "Gina"))
    assert share == pytest.approx(60 / 63) and not changed  # no mapping: what is literal counts


# Chat


def test_escapes_are_reversible():
    rng = np.random.default_rng(0)
    for _ in range(500):
        text = "".join(rng.choice(["<", "|", "\\", "<|", "im_end|>", "\n", "n", "a"], 12))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
        laid, a, b = chat.layout(text, text)
        assert chat.turns_of(laid + laid) == [(text, text)] * 2 and chat.unescape(laid[a:b]) == text


TURNS = "conv_id bigint, turn bigint, role string, text string, window int"


def conversations():
    rng = np.random.default_rng(2)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("assistant" if t % 2 else "user"), words(rng, int(rng.integers(1, 60)))) for c in range(12) for t in range(int(rng.integers(1, 30)))]
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, 1, "assistant", ""), (51, None, "assistant", "no turn"), (None, 0, "user", "no conv"), (None, 1, "assistant", "<|im_end|>")]
    rows += [(60, t, "assistant", f"a{t}") for t in range(40)] + [(61, 0, "assistant", words(rng, 4000))] + [(62, 3, "user", "same")] * 3
    return rows


def brute_windows(said, budget, history, chunk):
    """Windows of one conversation by plain lists: (repeated turns, new turns), cut after about every `chunk` rows."""
    size = lambda t: -(-len(chat.layout(*t)[0]) // 4)
    turns = [(role, text) for *_, role, text in said]
    system = turns[0] if turns[0][0] == "system" else None
    cuts = [0]
    for k in range(1, len(said)):
        if said[k][:2] != said[k - 1][:2]:  # another turn number
            if len(said) > chunk and k // chunk != cuts[-1] // chunk:
                cuts.append(k)
    out, lo = [], 0
    while lo < len(turns):
        end = min([c for c in cuts if c > lo], default=len(turns))
        fixed = size(system) if system else 0
        room, k = min(history, budget - fixed - size(turns[lo])), lo
        while k - 1 >= (1 if system else 0) and sum(map(size, turns[k - 1 : lo])) <= room:
            k -= 1
        total, hi = (fixed if lo or not system else 0) + sum(map(size, turns[k:lo])) + size(turns[lo]), lo + 1
        while hi < end and total + size(turns[hi]) <= budget:
            total += size(turns[hi])
            hi += 1
        out.append(([system] if system and lo else []) + turns[k:lo])
        out[-1] = (out[-1], turns[lo:hi])
        lo = hi
    return out


@pytest.mark.parametrize("chunk", [chat.CHUNK, 7])
def test_chat_round_trip(spark, chunk):
    rows = conversations()
    turns = spark.createDataFrame([(*r, 1) for r in rows], TURNS)
    windows = chat.format_chats(turns, budget=150, history=40, chunk=chunk)
    found = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(found) == set(by)
    for c, said in by.items():
        said.sort()
        r = found[c]
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in said).encode()).hexdigest()
        loss = "".join(text for *_, role, text in said if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = {}
    for w in sorted(windows.collect(), key=lambda w: (w.chunk, w.window)):
        parts = chat.turns_of(w.formatted)
        assert w.n_tokens <= 150 or len(parts) - w.n_repeated == 1
        shown.setdefault(w.conv_id, []).append((parts[: w.n_repeated], parts[w.n_repeated :]))
    assert shown == {c: brute_windows(said, 150, 40, chunk) for c, said in by.items()}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_turn_numbers_far_apart_change_no_window(spark):
    rows = [(c, t, "system" if t == 0 else ("user" if t % 2 else "assistant"), f"turn {t} of it") for c in (1, None) for t in range(30)]
    shown = []
    for far in (1, 5000):
        turns = spark.createDataFrame([(c, t * far, role, text) for c, t, role, text in rows], "conv_id bigint, turn bigint, role string, text string")
        windows = chat.format_chats(turns, budget=90, history=30, chunk=8).collect()
        shown.append(sorted((w.conv_id or 0, w.chunk, w.window, w.formatted, w.n_repeated) for w in windows))
    assert shown[0] == shown[1]
    assert all(n >= 2 for _, chunk, window, _, n in shown[0] if chunk or window)  # the system turn and history, across cuts too


# Mixing


def test_mixing_meets_targets(spark):
    rows, labels = quality_rows(400, 4)
    held = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = mixing.mix(table(spark, rows + ODD), held, shares=(0.5, 0.0, 0.5, 0.0)).collect()
    assert len(out) == len(rows) + len(ODD)
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in out])
    total = sum(r.n_tokens for r in out)
    got = (p * np.array([[r.expected_tokens] for r in out])).sum(0) / total
    assert np.allclose(got, [0.5, 0, 0.5, 0], atol=0.02) and all(r.rate >= 0 for r in out)
    assert mixing.mix(table(spark, []), held).count() == 0


def test_rates_are_least_squares(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 4, 200)
    n = rng.integers(1, 50, 200)
    members = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(200)], "doc_id bigint, n_tokens bigint, p array<double>")
    for shares, looks in (([0.7, 0.1, 0.1, 0.1], 30), ([1.0, 0.0, 0.0, 0.0], 12)):
        want = np.array(shares) * n.sum()
        fit = mixing.fit_rates(members, want, looks, written=2)
        rate = np.array([r.rate for r in fit.members.orderBy("doc_id").collect()])
        gap = ((p * (n * rate)[:, None]).sum(0) - want) / n.sum()
        brute = np.ones(200)  # plain projected gradient, many steps
        for _ in range(4000):
            brute = np.maximum(0, brute - 0.5 * p @ (((p * (n * brute)[:, None]).sum(0) - want) / n.sum()))
        rest = ((p * (n * brute)[:, None]).sum(0) - want) / n.sum()
        start = ((p * n[:, None]).sum(0) - want) / n.sum()
        # What can't be reached is approached slowly, and the result says that it isn't reached.
        assert (rate >= 0).all() and (gap**2).sum() <= (rest**2).sum() + (1e-9 if shares[0] < 1 else 0.02 * (start**2).sum())
        assert fit.residual == pytest.approx(np.abs(gap).max(), abs=1e-9) and fit.converged == (shares[0] < 1)


def test_a_target_out_of_reach_is_said(spark):
    members = spark.createDataFrame([(i, 5, [0.5, 0.5, 0.0, 0.0]) for i in range(20)], "doc_id bigint, n_tokens bigint, p array<double>")
    fit = mixing.fit_rates(members, np.array([50.0, 0.0, 50.0, 0.0]))
    assert not fit.converged and fit.residual == pytest.approx(0.5, abs=1e-3)


def test_domains_of_held_out_rows(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(500):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        said = words(rng, 150).split()
        if toxic:
            said[10::40] = ["vile"] * len(said[10::40])
        text = " ".join(said)
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text))
        labels.append((i, int(not junk), int(toxic)))
    learned = spark.createDataFrame(labels[:300], "doc_id bigint, quality int, toxic int")
    model = mixing.train(table(spark, rows), learned)
    p, _ = mixing.posteriors(model, pa.array([t for _, t in rows[300:]]))
    truth = np.array([(0 if q else 2) + x for _, q, x in labels[300:]])
    for k in (0, 1, 2):
        assert np.mean(p.argmax(1)[truth == k] == k) > 0.8


def test_tokens_of_a_mixture(spark):
    rows, labels = quality_rows(30, 4)
    held = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = mixing.mix(table(spark, rows + ODD), held, tokenizer=TOKENIZER).collect()
    count = token_counts.counter(TOKENIZER)
    want = sorted(count([t or "" for _, t in rows + ODD]))
    assert sorted(r.n_tokens for r in out) == want and len({(r.residual, r.converged) for r in out}) == 1


# Token counts


def test_token_counts_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(0)
    rows = [(i, "".join(rng.choice([*"abc 'sXÄé9\n\t", "  ", "<|endoftext|>", "漢", " ", "\x1c", "don't", "…"], 60))) for i in range(80)] + ODD
    library = Tokenizer.from_file(TOKENIZER)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    cache = f"file://{tmp_path}/cache"
    found = token_counts.contract_columns(token_counts.count_tokens(table(spark, rows), TOKENIZER, cache)).collect()
    assert len(found) == len(rows)
    assert all((r.n_bytes, r.n_tokens) == want[r.doc_id] and r.over_limit == (r.n_tokens > 512) for r in found)
    place = f"{cache}/tokenizer={token_counts.tokenizer_digest(TOKENIZER)[:32]}"
    before = spark.read.parquet(place).count()
    token_counts.count_tokens(table(spark, rows + [(999, "something new")]), TOKENIZER, cache).count()
    assert before == len({t or "" for _, t in rows}) and spark.read.parquet(place).count() == before + 1
    assert token_counts.count_tokens(table(spark, []), TOKENIZER).count() == 0


def test_other_tokenizers_count_as_their_libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Hello  World 12", "", "éà <|endoftext|>"]
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.counter(path)(texts) == [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.counter(path)(texts) == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]


# The pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows, labels = quality_rows(150, 6)
    near = [(1000 + i, t) for i, (_, t) in enumerate(near_rows(4))]
    bench_text = words(np.random.default_rng(9), 25)
    rows += near + [(3000, rows[0][1] + " "), (3001, "x y z. " + bench_text), (3002, near[0][1])]
    df = table(spark, rows).drop("_id", "shingle", "digest")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench_text)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == df.columns
        before = {r.doc_id: r.text for r in now.collect()}
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {r.doc_id for r in now.collect()}
        if k == 1:
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i]), i)
            assert kept == set(first.values())
        if k == 2:
            items = sorted(before.items())
            assert kept == {i for i, _, c in brute_components(items) if i == c}
        if k == 3:
            assert set(before) - kept == {i for i, t in before.items() if bench_text in t}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept and all(r.rate >= 0 for r in out)
