import pytest

from parley.llm import decontaminate as C

ITEM = "A farmer named Miller sold 12 kg of apples to Jones for 40 dollars and then bought 7 lb of seeds. How many apples did Miller sell in all?"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, ITEM, 3), (2, "What is the capital of the large island that lies south of the old continent", 3), (3, "short item", 3), (4, None, 3), (None, ITEM, 3), (5, "", 3)]
    return spark.createDataFrame(rows, "item_id bigint, text string, doc_id int")


def found(docs, bench, **options):
    return {(r["doc_id"], r["item_id"]): r for r in C.contaminated(docs, bench, **options).collect()}


def test_copies_and_reparameterised_questions_are_caught(docs_of, bench):
    filler = "some words of no importance stand here before and after the passage itself. "
    again = ITEM.replace("Miller", "Baker").replace("Jones", "Smith").replace("12 kg", "93 kg").replace("40", "77").replace("7 lb", "5 oz")
    docs = docs_of([(10, filler + ITEM + " " + filler), (11, filler + again), (12, filler * 5), (13, ITEM.lower()), (14, "What is the capital of the large island that lies north of a young country")])
    got = found(docs, bench)
    assert (10, 1) in got and got[10, 1]["changed"] == 0 and got[10, 1]["covered"] == got[10, 1]["item_tokens"]
    assert (11, 1) in got and got[11, 1]["changed"] > 0
    assert not [k for k in got if k[0] == 12]


def test_inconsistent_slots_do_not_count(docs_of, bench):
    """The item's one farmer becomes two: no re-parameterisation."""
    broken = ITEM.replace("Miller", "Baker", 1).replace("Jones", "Smith").replace("did Miller", "did Cooper")
    fine = ITEM.replace("Miller", "Baker").replace("Jones", "Smith")
    merged = ITEM.replace("Miller", "Smith").replace("Jones", "Smith")
    got = found(docs_of([(1, broken), (2, fine), (3, merged)]), bench)
    assert (2, 1) in got and (1, 1) not in got and (3, 1) not in got


def naive_templates(text):
    """Template tokens word by word."""
    import re

    out, last, begins = [], None, True
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+|[\n.!?]", text):
        w = m[0]
        if w in "\n.!?":
            begins = True
            continue
        if w[0].isdigit():
            kind = "<num>"
        elif last is not None and last[1] == "num-word" and w.lower() in C.UNITS:
            kind = "<unit>"
        elif "A" <= w[0] <= "Z" and not begins:
            kind = "<name>"
        else:
            kind = w.lower()
        if out and kind == out[-1] and kind in ("<num>", "<name>"):
            pass
        else:
            out.append(kind)
        last = (kind, "num-word" if w[0].isdigit() else "")
        begins = False
    return out


@pytest.mark.parametrize("text", [ITEM, "Dr. Anna Maria Smith ran 3.5 km in 10 min.", "no slots at all here", "12 KG of Steel\nAnd More", "1 2 3 km km"])
def test_templates_are_the_naive_ones(text):
    import pyarrow as pa

    (_, _, t), = C.templates(pa.array([text]))
    want = naive_templates(text)
    assert len(t.code) == len(want)
    ids = {}
    assert [ids.setdefault(c, len(ids)) for c in t.code.tolist()] == [{w: i for i, w in enumerate(dict.fromkeys(want))}[w] for w in want]
    assert t.slot.tolist() == [w[0] == "<" for w in want]


def test_odd_rows(docs_of, bench):
    long = "word " * 150_000
    rows = [(1, None), (2, ""), (3, long + ITEM + long), (None, ITEM), (4, ITEM), (4, ITEM), (5, "a short item"), (6, "short")]
    docs = docs_of(rows)
    got = C.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(3, 1), (4, 1), (4, 1), (5, 3)]
    kept = C.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 2), (False, 6), (True, None)]
    assert C.contaminated(docs_of([]), bench).collect() == [] and C.contaminated(docs, bench.where("false")).collect() == []
    assert C.decontaminate(docs, bench.where("false")).count() == len(rows)


def test_rows_that_repeat_ids(docs_of, bench):
    docs = docs_of([(1, ITEM), (1, "clean words only"), (1, None), (2, "more clean words"), (2, "more clean words"), (None, ITEM)])
    for options in ({}, {"items_per_pass": 1}):
        kept = C.decontaminate(docs, bench, **options)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, "clean words only"), (1, None), (2, "more clean words"), (2, "more clean words"), (None, ITEM)], key=repr)


def naive_readings(text):
    """Tokens of each reading as (kind, value), word by word; ASCII texts only."""
    import re

    words, begins = [], True
    for m in re.finditer(r"[0-9A-Za-z]+|[\n.!?]", text):
        if m[0] in "\n.!?":
            begins = True
        else:
            words.append((m[0], begins))
            begins = False
    unit = [i > 0 and w.lower() in C.UNITS and words[i - 1][0][0].isdigit() and not w[0].isdigit() for i, (w, _) in enumerate(words)]
    inner = {w.lower() for i, (w, b) in enumerate(words) if w[0].isupper() and not b and not unit[i]}
    out = []
    for named in ("inner", "all", "none"):
        tokens = []  # kind, value, first word
        for i, (w, b) in enumerate(words):
            name = w[0].isupper() and not unit[i] and (not b or named == "all" and w.lower() in inner)
            kind = w.lower() if named == "none" else "<num>" if w[0].isdigit() else "<unit>" if unit[i] else "<name>" if name else w.lower()
            if kind in ("<num>", "<name>") and tokens and tokens[-1][0] == kind:
                tokens[-1] = (kind, tokens[-1][1] + (w.lower(),), tokens[-1][2])
            else:
                tokens.append((kind, (w.lower(),), i))
        out.append((tokens, len(words)))
    return out


def naive_cover(item, text):
    """How many template tokens of an item a text covers, by trying every pair of positions."""
    base = naive_readings(item)[0][0]
    on = set()
    items, docs = naive_readings(item), naive_readings(text)
    for d, options in ((docs[0], items[:2]), (docs[1], items[:2]), (docs[2], items[2:])):
        for it, n_words in options:
            k = min(C.WINDOW, len(it))
            if not k:
                continue
            dt = d[0]
            for shift in range(-len(it), len(dt)):
                starts = [p for p in range(len(it) - k + 1) if 0 <= p + shift <= len(dt) - k and all(it[p + x][0] == dt[p + shift + x][0] for x in range(k))]
                while starts:
                    run = [starts.pop(0)]
                    while starts and starts[0] <= run[-1] + k:
                        run.append(starts.pop(0))
                    a, b = run[0], run[-1] + k
                    pairs = {(it[p][1], dt[p + shift][1]) for p in range(a, b) if it[p][0][0] == "<"}
                    if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                        end = it[b][2] if b < len(it) else n_words
                        on |= set(range(it[a][2], end))
    ends = [t[2] for t in base[1:]] + [naive_readings(item)[0][1]]
    return sum(all(w in on for w in range(t[2], e)) for t, e in zip(base, ends)), len(base)


def test_whole_query_is_brute_force(spark, docs_of):
    """Random items, and texts made of their changed parts: what is covered is what the comparison of all positions covers."""
    import random

    r = random.Random(8)
    words = "sold bought apples seeds then and how many of to the farm left in all day was".split()
    names, units = ["Miller", "Jones", "Baker", "Smith"], ["kg", "km", "days"]

    def item():
        out = []
        for _ in range(r.randrange(3, 30)):
            x = r.random()
            out.append(r.choice(names) if x < 0.15 else f"{r.randrange(1, 9)} {r.choice(units)}" if x < 0.25 else str(r.randrange(1, 30)) if x < 0.35 else r.choice(words))
        return " ".join(out).replace(" then", ". Then")

    items = [(i, item()) for i in range(25)]
    rows = []
    for i in range(150):
        t = r.choice(items)[1].split()
        for _ in range(r.randrange(3)):
            k = r.randrange(len(t))
            t[k] = r.choice(names + words + ["5", "kg"])
        if r.random() < 0.5:
            swap = dict(zip(names, r.sample(names, 4)))
            t = [swap.get(x, x) for x in t]
        t = " ".join(t[: r.randrange(1, len(t) + 1)] if r.random() < 0.3 else t)
        rows.append((i, r.choice([t, t.upper(), t.lower(), "the day. " + t + " left"])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((d, i, *naive_cover(x, t)) for d, t in rows for i, x in items if naive_cover(x, t)[0] >= 0.5 * naive_cover(x, t)[1])
    for options in ({}, {"items_per_pass": 7}):
        assert sorted((x["doc_id"], x["item_id"], x["covered"], x["item_tokens"]) for x in C.contaminated(docs_of(rows), bench, **options).collect()) == want
    assert len(want) > 50


def test_passes_give_the_same(docs_of, bench):
    docs = docs_of([(1, ITEM), (2, "the capital of the large island that lies south of the old continent")])
    whole = sorted(map(repr, C.contaminated(docs, bench).collect()))
    assert sorted(map(repr, C.contaminated(docs, bench, items_per_pass=1).collect())) == whole and len(whole) == 2


def test_copies_in_other_capitals_are_caught(docs_of, bench, spark):
    got = found(docs_of([(13, ITEM.lower()), (14, ITEM.upper()), (15, "before. " + ITEM.title() + " after")]), bench)
    for doc in (13, 14, 15):
        assert (doc, 1) in got and got[doc, 1]["covered"] == got[doc, 1]["item_tokens"] == 29 and got[doc, 1]["changed"] == 0
    item = "Übung macht den Meister, sagt Émile Öztürk, und Ärger über 3 Äpfel übt auch Özil"
    other = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    assert set(found(docs_of([(1, item.upper()), (2, item.lower()), (3, item.replace("Émile Öztürk", "Ömer")), (4, None)]), other)) == {(1, 9), (2, 9), (3, 9)}


def test_names_that_begin_sentences(docs_of, spark):
    """Each sentence begins with the name, so that all windows of the item hold it there."""
    item = "Miller has 12 apples. Miller buys 3 pears. Miller eats 4 plums. Miller finds 5 nuts. How many fruits has Miller?"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    each = item
    for name in ("Baker", "Cook", "Dean", "Evans", "Fox"):
        each = each.replace("Miller", name, 1)
    got = found(docs_of([(1, item.replace("Miller", "Baker")), (2, each), (3, each + " Baker, Cook, Dean, Evans, Fox")]), bench)
    assert set(got) == {(1, 1)} and got[1, 1]["covered"] == got[1, 1]["item_tokens"] and got[1, 1]["changed"] == 5


def test_an_edited_mention_leaves_the_rest_of_a_copy(docs_of, spark):
    item = "The baker mixes 12 g of salt into the dough and lets it rest over night in a cool room before the first 12 loaves are made from it and then sold"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = found(docs_of([(1, item.replace("first 12", "first 13"))]), bench)[1, 1]
    assert got["covered"] == got["item_tokens"] - 1
