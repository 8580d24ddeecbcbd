import pytest

from inkstone.llm import template_decontamination as t

from .helpers import awkward, prose, table

QUESTION = "If Alice has 12 kg of apples and gives Bob 5 kg of apples, how many kg has Alice left? Nobody knows the whole of it."
ITEMS = [(1, QUESTION), (2, "Tiny item"), (3, prose(77, 30)), (4, None), (5, ""), (None, prose(3, 30)), (3, prose(77, 30)), (6, "%%% ...")]


def bench(spark, rows=ITEMS):
    return table(spark, rows, schema="item_id bigint, text string")


def run(spark, rows, items=ITEMS, **options):
    found = t.contamination(table(spark, rows), bench(spark, items), **options).collect()
    return {(r.doc_id, r.item_id): r.kind for r in found}


CASES = [
    (1, "Before it. " + QUESTION + " After it."),
    (2, QUESTION.lower()),
    (3, QUESTION.upper()),
    (4, QUESTION.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "40").replace("5", "8")),
    (5, "If Alice has 12 kg of apples and gives Alice 5 kg of apples, how many kg has Zoe left? Nobody knows the whole of it."),
    (6, "some Tiny item here"),
    (7, "tiny other item"),
    (8, prose(1, 50) + " " + prose(77, 30) + " " + prose(2, 50)),
    (9, prose(1, 50) + " " + " ".join(prose(77, 30).split()[:15])),
    (10, " ".join(w + "%%%" for w in prose(77, 30).split())),
    (11, prose(78, 400)),
]
EXPECTED = {(1, 1): "copy", (2, 1): "copy", (3, 1): "copy", (4, 1): "reparameterised", (6, 2): "copy", (8, 3): "copy", (10, 3): "copy"}


def test_copies_and_changed_parameters(spark):
    assert run(spark, CASES) == EXPECTED


def test_large_benchmarks_take_the_joined_way(spark):
    assert run(spark, CASES, most=0) == EXPECTED


@pytest.mark.parametrize("most", [10**6, 0])
def test_awkward_rows(spark, most):
    assert run(spark, awkward(), most=most) == {}
    assert run(spark, [], most=most) == {}
    assert run(spark, CASES, items=[], most=most) == {}


def test_containment_matches_brute_force(spark):
    """Words that are all slots keep their values, so the share of an item's distinct 5-word windows decides."""
    items = [(k, prose(300 + k, 40, 9)) for k in range(5)]
    docs = [(k, " ".join(prose(300 + k % 5, 40, 9).split()[: 40 - 2 * (k // 5)]) + " " + prose(900 + k, 30, 9)) for k in range(30)]

    def windows(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    expected = {(d, i): "copy" for d, text in docs for i, item in items if len(windows(item) & windows(text)) >= 0.8 * len(windows(item))}
    assert 0 < len(expected) < 30
    assert run(spark, docs, items) == expected
    assert run(spark, docs, items, most=0) == expected


def test_templates_of_slots_alone_are_no_evidence(spark):
    items = [(1, "Alice 12 Bob 13 Carol 14 Dan 15 Eve 16")]
    rows = [(1, "Zoe 22 Yan 23 Xia 24 Wim 25 Val 26"), (2, "x Alice 12 Bob 13 Carol 14 Dan 15 Eve 16 y")]
    assert run(spark, rows, items) == {(2, 1): "copy"}


SORT = "Sort these numbers in ascending order: {} and give the middle one"


@pytest.mark.parametrize("most", [10**6, 0])
def test_changed_values_in_windows_of_slots_alone(spark, most):
    few, many = "8 3 12 7 5 19 1", " ".join(str(k * k + 2) for k in range(10))
    words = "x as y and z or p if q so r up s in"
    items = [(1, SORT.format(few)), (2, words + " " + many), (3, "Compute 17 + 25 - 8 + 31 - 12"), (4, "and " + many)]
    rows = [
        (1, "Before it. " + SORT.format("40 22 31 65 90 14 77") + " after it."),
        (2, SORT.format("40 22 40 22 40 22 40")),  # no consistent substitution
        (3, words + " " + " ".join(str(k + 500) for k in range(10))),
        (4, words + " 501 502 503 504 no other number stands here"),  # windows of words alone are not all of it
        (5, "Add two and " + many + " to it"),
        (6, "Compute 4 + 9 - 6 + 3 - 5"),  # more than half is slots: copies only
        (7, "compute 17 + 25 - 8 + 31 - 12"),
        (8, "then " + many),  # not the window with a word, but enough of all
    ]
    assert run(spark, rows, items, most=most) == {(1, 1): "reparameterised", (3, 2): "reparameterised", (5, 4): "copy", (7, 3): "copy", (8, 4): "copy"}


def test_repeated_ids_are_one_row(spark):
    rows = [(1, QUESTION), (1, QUESTION), (1, "nothing"), (None, QUESTION)]
    assert run(spark, rows) == {(1, 1): "copy"}


def test_both_paths_report_the_same_rows(spark):
    """Repeated clauses with all names changed, short items, repeated ids, shared windows, copies with changed case."""
    clause = "{} has met {} in {} today "
    names = ["Alice", "Bob", "Carol", "Dan", "Erin", "Fay", "Gus", "Hal", "Ida", "Jon", "Kim", "Lea"]
    others = [x[::-1].capitalize() for x in names]
    repeated = "".join(clause.format(*names[3 * k : 3 * k + 3]) for k in range(4))
    items = [(1, repeated), (2, QUESTION), (3, "Two words"), (3, "one"), (4, prose(61, 30, 40)), (5, prose(62, 30, 40)), (6, ""), (7, None), (8, "Who is 7 m tall")]
    rows = [(1, "x " + "".join(clause.format(*others[3 * k : 3 * k + 3]) for k in range(4)) + "y"), (2, repeated.lower()), (3, QUESTION.upper()), (4, "two Words"), (4, "and one more"), (5, prose(61, 30, 40)), (6, " ".join(prose(62, 30, 40).split()[:26])), (7, None), (8, ""), (9, "Who is 9 m tall"), (10, "here " * 3000 + repeated)]
    both = []
    for most in (10**6, 0):
        out = t.contamination(table(spark, rows), table(spark, items, schema="item_id bigint, text string"), most=most).collect()
        both.append(sorted(tuple(r) for r in out))
    assert both[0] == both[1]
    assert {(r[0], r[1]) for r in both[0]} >= {(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (10, 1)}


def test_a_join_takes_only_lengths_the_benchmark_has(spark):
    prefixes = t._prefixes(spark.createDataFrame([(1, prose(71, 40)), (2, "a b")], "item_id bigint, text string"))
    assert {r.words for r in prefixes.collect()} == {2, t.WINDOW}
    assert t._sieve(prefixes).sum() > 0
