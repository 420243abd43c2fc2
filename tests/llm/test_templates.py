"""Template windows against plain Python, and re-parameterised questions."""

import re

import numpy as np

from paperloom.llm import templates

ITEM = "A train leaves Paris at 9 and runs 120 km in 2 hours while Maria waits near Lyon for 45 minutes, how far does it go in 2 hours after that stop"


def plain_tokens(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        t = re.sub(r"^[^0-9A-Za-z%\x80-\U0010FFFF]+|[^0-9A-Za-z%\x80-\U0010FFFF]+$", "", w)
        if not t:
            continue
        low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t)
        if re.search("[0-9]", t):
            kind = templates.NUMBER
        elif low in templates.UNITS:
            kind = templates.UNIT
        elif re.match("[A-ZÀ-ÖØ-ÞŁŻΑ-ΩЀ-Я][^A-Z0-9]", t) and low not in templates.COMMON:
            kind = templates.NAME
        else:
            kind = templates.LITERAL
        out.append((kind, low if kind == templates.LITERAL else t.lower()))
    return out


def plain_leaks(docs, items):
    """Pairs by the definition: windows of each width, coverage and slots on each alignment."""

    def windows(tokens, width):
        rows = []
        for i in range(len(tokens) - width + 1):
            part = tokens[i : i + width]
            if any(k == templates.LITERAL for k, _ in part):
                rows.append((i, tuple((k, w if k == templates.LITERAL else "") for k, w in part), [w for k, w in part if k != templates.LITERAL]))
        return rows

    found = set()
    for d, text in docs:
        for n, item in items:
            tokens = plain_tokens(item)
            width = min(templates.WINDOW, len(tokens))
            asked, held = windows(tokens, width), windows(plain_tokens(text), width) if width else []
            met = [(a, h) for a in asked for h in held if a[1] == h[1]]
            if not asked or len({a[0] for a, _ in met}) < templates.COVERAGE * len(asked):
                continue
            values = {}
            for a, h in met:
                for x, y in zip(a[2], h[2]):
                    values.setdefault((h[0] - a[0], x), set()).add(y)
            if sum(len(v) > 1 for v in values.values()) <= templates.MAX_CONFLICTS * len(values):
                found.add((d, n, any(x != y for (_, x), v in values.items() for y in v)))
    return found


def test_tokens_match_plain_python():
    texts = [ITEM, "", "Été à Évian. Zoë a 3,5 kg! $$$the*** (Bob) said: Go | x | 50% Of", "Łódź in Żary, Ελλάς Москва łódź. The Cat", " ... ", "A\nBc de Fg"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    joined = np.frombuffer(b"".join(data), np.uint8)
    starts, ends, kinds, hashes, first = templates.tokens(joined, offsets, templates.word_hashes(templates.UNITS), templates.word_hashes(templates.COMMON))
    low = lambda b: re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), b.decode())
    for i, t in enumerate(texts):
        r = range(first[i], first[i + 1])
        assert [(int(kinds[k]), low(joined[starts[k] : ends[k]].tobytes()) if not kinds[k] else "") for k in r] == [(k, w if not k else "") for k, w in plain_tokens(t)]


def test_reparameterised_and_inconsistent_questions(spark):
    other = ITEM.replace("120", "300").replace("2 hours", "5 hours").replace("Maria", "Anna").replace("Paris", "Rome")
    docs = [(1, f"Words before. {ITEM}. Words after."), (2, f"Before. {other}."), (3, "Something else entirely that has 120 km in it"), (4, None), (5, ""), (6, ITEM[:60])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in docs + [docs[0]]], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in templates.leaks(docs, items).collect()}
    assert {k: r.kind for k, r in found.items()} == {(1, 7): "verbatim", (2, 7): "reparameterised"}
    kept = templates.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    loose = spark.createDataFrame([(1, " ".join(f"of {w} 2 km to the north side" for w in "abcdefgh"))], "item_id long, text string")
    clash = spark.createDataFrame([(1, " ".join(f"of {w} {i} km to the north side" for i, w in enumerate("abcdefgh")))], "doc_id long, text string")
    assert templates.leaks(clash, loose).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert templates.leaks(none, items).count() == 0
    assert templates.leaks(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


APPLES = "Alice has 12 apples in a red box. Bob gives her 5 more and the box is full. Alice eats 3 of the apples, how many are left in the box?"


def test_leaks_match_brute_force(spark):
    swapped = APPLES.replace("Alice", "Maria").replace("Bob", "Juan")
    many = swapped.replace("12", "70").replace("5 more", "9 more").replace("3 of", "4 of")
    clash = APPLES.replace("Alice eats", "Carol eats").replace("apples,", "pears,")
    docs = [APPLES, swapped, many, f"Before this. {many} {APPLES}", clash, APPLES[:70], "Nothing of it", f"{ITEM} {ITEM}", "we say red green blue here", "", "12 13 14", APPLES.upper()]
    items = [APPLES, ITEM, "red green blue", "7 8", ""]
    frame = lambda texts, i: spark.createDataFrame(list(enumerate(texts)), f"{i} long, text string")
    found = {(r.doc_id, r.item_id, r.kind != "verbatim") for r in templates.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert found == plain_leaks(enumerate(docs), list(enumerate(items)))
    assert {(1, 0, True), (2, 0, True), (3, 0, True), (8, 2, False)} <= found


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, ITEM, 5, 6, 7), (1, ITEM, 5, 6, 7), (2, None, 5, 6, 7), (None, "", 5, 6, 7)], "doc_id long, text string, _d int, key int, row int")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    found = templates.decontaminate(docs, items)
    assert found.columns == docs.columns and sorted(map(str, found.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 2").collect()))
