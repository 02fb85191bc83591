from larkspur.llm import decontaminate as D

ITEM = "A train leaves Boston at 9 and travels 60 miles to reach Denver before the storm arrives, how many hours does Denver wait"


def pairs(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame(list(docs), "doc_id long, text string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.contaminated(d, b).collect()}


def test_verbatim_and_new_parameters(spark):
    again = ITEM.replace("Denver", "Paris").replace("60", "75").replace("Boston", "Rome")
    mixed = ITEM.replace("Denver", "Paris", 1).replace("60", "75")  # one item value, two document values
    got = pairs(spark, [(1, "Foo bar. " + ITEM + " baz"), (2, "Well: " + again), (3, "nothing of the sort here at all"), (4, None), (5, ""), (None, ITEM), (1, "Foo bar. " + ITEM + " baz")])
    assert set(got) == {(1, 1), (2, 1), (None, 1)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[2, 1].coverage > 0.8
    assert (9, 1) not in {k for k, r in pairs(spark, [(9, mixed)]).items() if r.verbatim}


def test_inconsistent_slots_are_not_a_leak(spark):
    item = "give Anna the box and Anna the key and Anna the map and Anna the coin for tea"
    fill = iter("Berta Carla Doris Emma".split())
    other = " ".join(next(fill) if w == "Anna" else w for w in item.split())
    same = item.replace("Anna", "Berta")
    got = pairs(spark, [(1, "Now " + other), (2, "Now " + same)], [(7, "Now " + item)])
    assert set(got) == {(2, 7)}


def test_slots_are_one_to_one_over_all_alignments(spark):
    item = "when Anna sees the red fox near Denver and Boris hears the old owl near Oslo then Anna calls Boris about the fox and the owl"
    words = item.split()
    swap = lambda text, **to: " ".join(to.get(w, w) for w in text.split())
    half = len(words) // 2
    shifted = " ".join([*swap(" ".join(words[:half]), Anna="Berta", Boris="Bodo").split(), "inserted", *swap(" ".join(words[half:]), Anna="Carla", Boris="Cuno").split()])
    docs = [(1, swap(item, Anna="Berta", Boris="Bodo", Denver="Paris")), (2, shifted), (3, swap(item, Anna="Zoe", Boris="Zoe", Denver="Zoe", Oslo="Zoe")), (4, f"{item} . {swap(item, Anna='Berta', Boris='Bodo')}")]
    got = pairs(spark, docs, [(7, item)])
    assert set(got) == {(1, 7), (4, 7)} and got[4, 7].verbatim and not got[1, 7].verbatim


def test_families_of_items_and_short_items(spark):
    again = ITEM.replace("Denver", "Paris").replace("60", "75")
    vague = "Anna 12 Berta 7 Carla 9 Doris"
    items = [(5, ITEM), (9, again), (9, again), (11, "Name two noble gases."), (12, vague), (13, ""), (14, None), (None, "alone again")]
    docs = [(1, "Prompt: " + again), (2, "First line\nName two noble gases.\nlast"), (3, "They name two noble gases in passing"), (4, "so " + vague + " it"), (6, "alone again")]
    got = pairs(spark, docs, items)
    assert set(got) == {(1, 5), (2, 11), (4, 12), (6, None)}
    assert got[1, 5].items == 2 and got[1, 5].verbatim  # it is the family's other item
    other = pairs(spark, [(1, "Prompt: " + again.replace("75", "80"))], items)
    assert not other[1, 5].verbatim


def brute_force(docs, items):
    """Word by word, without hashes: pairs of a document and an item whose alignments, of one occurrence, agree one to one."""
    def tokens(text):
        out, before = [], None
        for w in text.split():
            bare = w.strip(D._MARKS)
            low = bare.lower()
            number = low in D._NUMBERS or D._NUMBER.fullmatch(low)
            unit = low in D._UNITS and before and before[0] == "<num>"
            name = not number and low not in D._UNITS and bare[:1].isupper() and not bare[1:].isupper() and before is not None and before[2][-1] not in ".!?:;"
            out.append(("<num>" if number else "<unit>" if unit else "<name>" if name else low, low, w))
            before = out[-1]
        return out

    found = set()
    for d, text in docs:
        x = tokens(text)
        for i, item in items:
            y = tokens(item)
            clear = [p for p in range(len(y) - 4) if sum(not t.startswith("<") for t, _, _ in y[p : p + 5]) >= D.MIN_WORDS]
            hits = [(q - p, p, q) for p in clear for q in range(len(x) - 4) if [t for t, _, _ in y[p : p + 5]] == [t for t, _, _ in x[q : q + 5]]]

            def agree(hits):
                pairs = [(y[p + k][1], x[q + k][1]) for _, p, q in hits for k in range(5) if y[p + k][0].startswith("<")]
                share = 1.0
                for way in (0, 1):
                    of = {}
                    for pair in pairs:
                        of.setdefault(pair[way], []).append(pair)
                    if pairs:
                        share = min(share, sum(max(map(v.count, v)) for v in of.values()) / len(pairs))
                return share >= D.MIN_CONSISTENCY

            lines = sorted({h[0] for h in hits})
            lines = [n for n in lines if agree([h for h in hits if h[0] == n])]
            groups = []
            for n in lines:
                if not groups or n - groups[-1][-1] > max(5, len(clear) // 2):
                    groups.append([])
                groups[-1].append(n)
            for g in groups:
                mine = [h for h in hits if h[0] in g]
                if agree(mine) and len({p for _, p, _ in mine}) >= D.MIN_COVERAGE * len(clear):
                    found.add((d, i))
    return found


def test_placeholders_equal_brute_force(spark):
    rng = __import__("random").Random(11)
    word = lambda: rng.choice(["the", "train", "leaves", "Anna", "Berta", "Carla", "12", "7", "km", "and", "then", "stops", "near", "Oslo"])
    items = [(i, " ".join(word() for _ in range(rng.randint(9, 16)))) for i in range(12)]
    docs = []
    for n in range(60):
        base = rng.choice(items)[1].split()
        to = {w: word() for w in ("Anna", "Berta", "Carla", "12", "7", "Oslo") if rng.random() < 0.4}
        base = [to.get(w, w) if rng.random() < 0.95 else word() for w in base]
        docs.append((n, " ".join([*(word() for _ in range(rng.randint(0, 6))), *base, *(word() for _ in range(rng.randint(0, 6)))])))
    want = brute_force(docs, items)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(*(spark.createDataFrame(t, s) for t, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))).collect()}
    assert len(want) > 20 and got == want


def test_windows_equal_brute_force(spark):
    """Without placeholders a match is a shared run of five words."""
    items = [(i, " ".join(f"w{(i * 7 + k * 3) % 50}x" for k in range(12))) for i in range(5)]
    docs = [(i, " ".join(f"w{(i * 5 + k * 3) % 50}x" for k in range(30))) for i in range(20)]
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = {(d, i) for d, t in docs for i, x in items if len(grams(t) & grams(x)) >= 0.5 * len(grams(x))}
    assert want and set(pairs(spark, docs, items)) == want


def test_empty_and_clean(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (2, "short", 6), (None, ITEM, 7), (1, "another row of this id", 8)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short")], "item_id long, text string")
    assert sorted(tuple(r) for r in D.clean(docs, items).collect()) == [(1, "another row of this id", 8), (2, "short", 6)]
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0


def test_other_file_splits_change_nothing(spark, tmp_path):
    """Row numbers are written once: a table that is split otherwise between the steps loses the same documents."""
    rows = [(i, f"note {i} " + (ITEM if i % 5 == 0 else "about the weather"), i) for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(7, "doc_id").write.parquet(f"{tmp_path}/docs")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, "2")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        kept, found = D.clean(docs, items), D.contaminated(docs, items)
        spark.conf.set(key, "16")
        assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] % 5]
        assert {r.doc_id for r in found.collect()} == {i for i in range(0, 70, 5)}
    finally:
        spark.conf.unset(key)
