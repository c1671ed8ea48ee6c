"""Values and pairs that a narrower search would leave out."""

import random
from itertools import combinations

import pytest

from terrane.llm import decontamination, pii, simhash

CARD = "4539 1488 0343 6467"


@pytest.mark.parametrize("after", [" 12/27", " 100 euros", " 124 4567", " 2024-01-31", " 19.99", "-12/27", " 555-123-4567", " 12th"])
@pytest.mark.parametrize("card", [CARD, CARD.replace(" ", ""), CARD.replace(" ", "-")])
def test_cards_before_other_numbers_are_found(card, after):
    new, spans = pii.Pseudonyms(b"k").replace(f"card {card}{after}.")
    assert ("card", 5, 5 + len(card)) in spans and card not in new


def test_other_values_before_numbers_are_found():
    p = pii.Pseudonyms(b"k")
    assert p.replace("555-123-4567 200 times")[1] == [("phone", 0, 12)]
    assert p.replace("call 555 123 4567 200 300 now")[1] == [("phone", 5, 17)]
    assert p.replace("to DE89370400440532013000 2024 or DE89 3704 0044 0532 0130 00 150 EUR")[1] == [("iban", 3, 25), ("iban", 34, 61)]
    assert p.replace("runs 1234 5678 9012 3456 7890 12 and 4539148803436467124")[1] == []


@pytest.mark.parametrize(
    "kind, value",
    [
        *[("date", d) for d in ("31-12-1999", "12-31-1999", "1-2-2003", "2020/01/31", "2020/1/3", "2020.12.01", "1999-12-31", "31.12.1999", "12/31/1999")],
        *[("phone", n) for n in ("0044 20 7946 0958", "00353 1 234 5678", "020 7946 0958", "(020) 7946 0958", "01 23 45 67 89", "030-123-4567")],
        *[("iban", i) for i in ("GR1601101250000000012300695", "TR33 0006 1005 1978 6457 8413 26", "CZ6508000000192000145399", "NO9386011117947", "MT84MALT011000012345MTLCAST001S")],
        *[("email", e) for e in ("user@exämple.com", "jürgen.groß@example.org", "plain@example.com")],
        ("ipv6", "2001:0DB8:0000:0000:0000:8A2E:0370:7334"), ("ipv6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ],
)
def test_values_of_many_notations_are_replaced_and_undone(kind, value):
    p = pii.Pseudonyms(b"k")
    new, spans = p.replace(f"see {value}, then")
    assert spans == [(kind, 4, 4 + len(value))] and value not in new
    pseudonym = new[4:-6]
    assert p.replace(f"see {pseudonym}, then")[1] == [(kind, 4, 4 + len(pseudonym))]  # still one of its kind
    assert len(pseudonym) == len(value) and p._pseudonym(kind, pseudonym, back=True) == value


def test_an_address_in_short_form_is_linked_with_its_full_form():
    p = pii.Pseudonyms(b"k")
    assert p.replace("2001:db8::8a2e:370:7334")[0] == p.replace("2001:0db8:0000:0000:0000:8a2e:0370:7334")[0]


@pytest.mark.parametrize("text", ["12:34:56", "std::vector a::b", "version 1.02.33", "0123456789", "room 012 34", "32-13-1999", "2020/13/01", "GR1601101250000000012300696", "00 12 34", "007"])
def test_what_only_looks_like_personal_data_stays(text):
    assert pii.Pseudonyms(b"k").replace(text) == (text, [])


def _components(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}


def test_a_repeated_line_makes_no_near_duplicates(spark):
    rng = random.Random(5)
    line = "one header line of seven plain words\n" * 100
    texts = [line + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3)]
    assert len({tuple(simhash._sketch(t, 3, 3, 5)[0]) for t in texts}) < 3
    assert _components(spark, [*texts, texts[0]]) == {0: 0, 1: 1, 2: 2, 3: 0}


def test_pairs_in_large_groups_of_candidates_are_all_verified(spark):
    rng = random.Random(6)
    line = "one header line of seven plain words\n" * 100  # outvotes the rest: all are candidates of all
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    assert len({tuple(simhash._sketch(line + " ".join(t), 3, 3, 5)[0]) for t in texts}) < 40
    texts += [[*t[:30], "new", *t[31:]] for t in texts]
    assert _components(spark, [line + " ".join(t) for t in texts]) == {i: i % 40 for i in range(80)}


def _verdicts(spark, texts, items, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: r["items"] for r in decontamination.decontaminate(df, bench, **options).collect()}


def test_items_of_names_and_numbers_are_found(spark):
    items = ["Who was the 44th President of the United States?", "What is 12 times 7 plus 15 minus 3?", "Which country won the 1998 FIFA World Cup in France?"]
    texts = [f"Some words. {i} And more." for i in items] + [items[2].lower(), "What is 13 times 7 plus 15 minus 3?", None, ""]
    assert _verdicts(spark, texts, items) == {0: "0", 1: "1", 2: "2", 3: "2", 4: "", 5: "", 6: ""}


def test_lower_cased_copies_are_found(spark):
    item = "in the town of Salem the young baker Ruth sold bread to Peter and kept Monday free for Anna and the old mill"
    assert _verdicts(spark, [item.lower(), item.upper(), item.replace("Ruth", "Mary")], [item]) == {0: "0", 1: "0", 2: "0"}


def test_an_inconsistent_variant_does_not_hide_an_exact_copy(spark):
    item = "if Tom has 5 coins and gives 5 of them to Ann then Tom keeps the rest and Ann counts 5 new coins for the family"
    other = item.replace("5 coins", "8 coins").replace("gives 5", "gives 31").replace("counts 5", "counts 64").replace("Tom keeps", "Eve keeps").replace("Ann counts", "Joe counts")
    same = item.replace("5", "9").replace("Tom", "Eve").replace("Ann", "Joe")
    assert _verdicts(spark, [f"{item}. {other}", f"{other}. {other}. {same}", other], [item], literals=3) == {0: "0", 1: "0", 2: ""}


def test_every_item_can_be_found(spark):
    items = ["Name the capital", "What is 3 plus 4", "Compute 12 34 56 78 90 12 34 56 78 90 11 22 33", "Who Wrote The Old Man And The Sea In Nineteen Fifty One", "??", "yes"]
    texts = [*items[:4], items[3].upper(), "name the capital of this land and all others", "yes", None, "", "NAME   the\ncapital!"]
    assert _verdicts(spark, texts, items) == {0: "0", 1: "1", 2: "2", 3: "3", 4: "3", 5: "", 6: "5", 7: "", 8: "", 9: "0"}


def test_numbers_in_words_are_slots(spark):
    item = "a farmer keeps three cows and buys seven more from the market before the winter so how many cows stand there"
    assert _verdicts(spark, [item.replace("three", "12").replace("seven", "forty")], [item]) == {0: "0"}


def test_values_of_several_words_are_one_slot(spark):
    """The same question with numbers of another form, names of other lengths, and units."""
    item = "a worker is paid 12.5 dollars an hour on weekdays and 18.25 dollars on sundays and pays 4.75 for lunch so how much is left after 17.25 hours of work in one week"
    other = item.replace("12.5", "9").replace("18.25", "21").replace("4.75", "3").replace("17.25", "1,012")
    names = "on monday John lends the new book to Maria who reads it for a week before Maria gives the book back to John and asks for another one"
    longer = names.replace("John", "Paul van Dyk Smith".replace(" van ", " Van ")).replace("Maria", "Mary Ann Lee")
    words = "a shop sells twenty-five boxes at 1,200 each in may and then at 1,950 each in june so how much more does the shop take for the same boxes in june"
    digits = words.replace("twenty-five", "30").replace("1,200", "850").replace("1,950", "975")
    found = _verdicts(spark, [f"Text before. {other} Text after.", longer, digits, "other text"], [item, names, words])
    assert found == {0: "0", 1: "1", 2: "2", 3: ""}


def test_long_texts_and_points_are_tokens(spark):
    item = "the pump moves 3.5 litres each minute into a tank that holds 70 litres when it is full so how long does the tank take"
    long = " ".join(f"w{i} 1.{i}" for i in range(20_000))
    texts = [long + " " + item.replace("3.5", "2,000.25").replace("70", "9"), long, "... 1.,2 ,3. \ue000", item.replace("3.5", "three and a half")]
    assert _verdicts(spark, texts, [item]) == {0: "0", 1: "", 2: "", 3: "0"}


def test_near_copies_round_one_text(spark):
    """All Hamming candidates are verified, also in groups of more than a few dozen: the classes are those of brute force."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**5)}" for _ in range(200)]
    texts = []
    for _ in range(60):  # pairs of near copies; pairs differ from each other by more
        one = list(base)
        for at in rng.sample(range(200), 9):
            one[at] = f"x{rng.randrange(10**6)}"
        two = list(one)
        for at in rng.sample(range(200), 3):
            two[at] = f"y{rng.randrange(10**6)}"
        texts += [" ".join(one), " ".join(two)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    prints = [simhash._sketch(t, 3, simhash.PRINTS, 5)[0] for t in texts]
    true, candidates = set(), set()
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            true.add((i, j))
            if any((a ^ b).bit_count() <= simhash.WIDE_RADIUS for a, b in zip(prints[i], prints[j])):
                candidates.add((i, j))
    assert len(candidates) >= 0.9 * len(true) > 50
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in sorted(candidates):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile_rows in (simhash.TILE_ROWS, 32):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, tile_rows=tile_rows).collect()}
        assert got == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("bits, tile_rows", [(20, 4096), (3, 16)])
def test_sets_in_different_components_meet_by_rare_shingles(spark, bits, tile_rows):
    """The prefix join against all pairs; few counts and small tiles change no link."""
    rng = random.Random(9)
    base = rng.sample(range(-(2**31), 2**31), 90)
    sets = [[]]
    for i in range(120):
        own = rng.sample(base, 90 - rng.randrange(20)) if i % 3 else rng.sample(range(-(2**31), 2**31), 1 + i % 7)
        sets.append(sorted({*own, *rng.sample(range(-(2**31), 2**31), rng.randrange(12))}))
    sets += [s[: len(s) * 4 // 5] for s in sets if len(s) % 5 == 0 and s]  # exactly 0.8
    root = [i if i % 4 else min(i, 8) for i in range(len(sets))]
    rows = spark.createDataFrame([(str(i).encode(), s) for i, s in enumerate(sets)], "whole binary, shingles array<int>")
    classes = spark.createDataFrame([(i, str(i).encode(), len(s)) for i, s in enumerate(sets)], "cid long, whole binary, n int")
    members = classes.select("cid")
    roots = spark.createDataFrame([(i, r) for i, r in enumerate(root) if i != r], "node long, root long")
    found = simhash._ordered(simhash._links_across(members, roots, rows, classes, 0.8, tile_rows, bits))
    got = {(r.a, r.b) for r in simhash._verified(found, rows, classes, 0.8).collect()}
    assert all(root[a] != root[b] for a, b in got)
    true = {
        (i, j)
        for i, j in combinations(range(1, len(sets)), 2)
        if root[i] != root[j] and (both := len({*sets[i]} & {*sets[j]})) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
    }
    assert got == true and len(true) > 20


def _linked(texts):
    """Pairs that the rule links, by brute force."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    prints = [simhash._sketch(t, 3, simhash.PRINTS, 5)[0] for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        near = any((a ^ b).bit_count() <= simhash.WIDE_RADIUS for a, b in zip(prints[i], prints[j]))
        if near and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            yield i, j


def _smallest(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_change_no_link(spark, seed):
    """Similar pairs with and without many texts that are candidates of both: one rule for every size of a group."""
    rng = random.Random(seed)
    line = "one header line of seven plain words\n" * 60  # with it, all are candidates of each other
    pairs = []
    for k in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        copy = [*base[:38], "new"] if k % 2 else [base[0], "new", *base[2:]]
        pairs += [" ".join(base), " ".join(copy)]
    crowd = [line + " ".join(f"c{rng.randrange(10**6)}" for _ in range(60)) for _ in range(50)]
    crowd += [line + p for p in pairs]
    alone = _components(spark, pairs)
    assert alone == _smallest(len(pairs), _linked(pairs))
    whole = _components(spark, pairs + crowd)
    assert whole == _smallest(len(pairs + crowd), _linked(pairs + crowd))
    assert {i: whole[i] for i in alone} == alone


@pytest.mark.parametrize("words", [20, 30, 50, 200])
def test_candidates_hold_nine_tenths_of_similar_pairs(words):
    rng = random.Random(words)
    found = total = 0
    while total < 150:
        one = [f"w{rng.randrange(20000)}" for _ in range(words)]
        two = list(one)
        for _ in range(max(1, words // 40)):
            two[rng.randrange(words)] = f"w{rng.randrange(20000)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(words - 4)} for w in (one, two))
        if a != b and len(a & b) >= 0.8 * len(a | b):
            total += 1
            found += bool(list(_linked([" ".join(one), " ".join(two)])))
    assert found >= 0.9 * total
