"""Spellings: what belongs together, what does not, and linkage against merging one pair at a time."""

import itertools
import math
import random

import pytest

from pressmill.llm import names as N


def words(name, counts=None):
    """Words of a name with their counts; two unless told otherwise."""
    return [(*w, (counts or {}).get(w[0], 2)) for w in N.words_of(name)]


# titles and people that no list holds
ALIKE = [
    ("Lagos Clarion", "Clarion Lagos"), ("Lagos Clarion", "LAGOS  clarion"), ("Financial Times", "Fin. Times"), ("El País", "El Pais S.L."), ("Rotterdam Enterprise", "Rotterdam Enterpr."), ("Ostrava Beacon Weekly", "Ostrava Bcn Wkly"),
    ("Ostrava-Beacon-Weekly", "OstravaBeaconWeekly"), ("Ostrava BW", "Ostrava Beacon Weekly"), ("Ostrava Beacon", "Ostraav Beacon"), ("John Lee", "Jon Lee"), ("Quentin Abernathy", "Abernathy, Q. R."), ("Kate Abernathy", "Katherine Abernathy"),
    ("Jürgen Østby", "jurgen østby"), ("Q. Abernathy", "Abernathy, Q."),
]
APART = [
    ("Madrid Clarion", "Madras Clarion"), ("Lagos Clarion", "Lagos Herald"), ("Lagos Clarion", "Lagos Evening Clarion"), ("Susan Tapebupin", "Elizabeth Tapebupin"), ("Anthony Derumofali", "J. Derumofali"),
    ("Alexander L. Mibuliteni", "Mibuliteni, R."), ("J. Kaferapin", "Kaferapin, M. J."), ("Johannes Kaferapin", "Kaferapin, M. J."), ("Ostrava BW", "Ostrava Beacon Daily"), ("Ostrava", ""),
]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_spellings_of_one(a, b):
    assert N.likeness(words(a), words(b)) >= 0.5 and N.likeness(words(b), words(a)) >= 0.5


@pytest.mark.parametrize(("a", "b"), APART)
def test_different_publishers(a, b):
    assert N.likeness(words(a), words(b)) == 0 == N.likeness(words(b), words(a))


def test_two_usual_words_are_no_slip_of_each_other():
    counts = {"tides": 40, "times": 50, "tmes": 1}
    assert N.likeness(words("Lagos Times", counts), words("Lagos Tides", counts)) == 0
    assert N.likeness(words("Lagos Times", counts), words("Lagos Tmes", counts)) > 0.5


def test_edits():
    assert [N.edits(a, b) for a, b in (("ab", "ab"), ("ab", "ba"), ("abc", "ac"), ("abc", "axc"), ("abcd", "badc"), ("abcdef", "x"))] == [0, 1, 1, 1, 2, 3]


def frame(spark, names):
    return spark.createDataFrame([(n, 1) for n in names], "publisher string, name int")


SYLLABLES = "ba bel cor dan el fi gar hol in jo kra lum mor nat or pel qui ros sta tur ul ver wen yor zan".split()
TITLES = [("Clarion",), ("Evening", "Beacon"), ("Enterprise",), ("Mountain", "Argus"), ("Weekly", "Lantern"), ("Valley", "Pioneer")]


def corpus(seed=3, places=40):
    """Invented newsrooms and writers, each under several spellings; pairs of spellings that mean one."""
    r = random.Random(seed)
    made = set()
    while len(made) < places:
        made.add("".join(r.choice(SYLLABLES) for _ in range(3)).capitalize())
    groups = []
    for place in sorted(made):
        for title in r.sample(TITLES, 2):
            full = " ".join((place, *title))
            kinds = [full, full.upper(), f"{full} Stiftung", f"By {full}", f"{' '.join(title)}, {place}", f"{full} (Abendausgabe)", place[:3] + place[4] + place[3] + place[5:] + " " + " ".join(title), f"{place} {title[0][:4]}. {' '.join(title[1:])}".strip(), "".join((place, *title))]
            groups.append({full, *r.sample(kinds[1:], 4)})
        given = r.choice(["Quentin", "Ottilie", "Rosalba", "Wenceslas"])
        groups.append(set(r.sample([f"{given} {place}son", f"{place}son, {given[0]}. T.", f"{place}son {given}", f"{given} {place}son Stiftung"], 3)))
    want = {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}
    return sorted(set().union(*groups)), want


def test_recall_and_precision_without_hints(spark):
    names, want = corpus()
    got = {tuple(r) for r in N.group_pairs(N.publisher_groups(frame(spark, names * 2), "publisher", hints={})).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.98 * len(got)


def test_words_that_names_do_without(spark):
    names, _ = corpus()
    listed = N.read_names(frame(spark, names), "publisher").withColumn("texts", N.F.transform("words", lambda w: w["text"]))
    found = {r.phrase for r in N.dispensable(listed).collect()}
    assert {"stiftung", "by", "abendausgabe"} <= found and not found & {"clarion", "beacon", "evening", "weekly", "quentin"}


def test_odd_names(spark):
    names = [None, "", "  ", "!!!", "Ltd", "12", "x" * 20_000, "a b " * 2_000, "Lagos Clarion", "lagos  clarion", "Clarion, Lagos", "Lagos Clarion", "James Kaferapin", "Johannes Kaferapin", "J. Kaferapin", "Kaferapin, J."]
    pairs = {tuple(r) for r in N.group_pairs(N.publisher_groups(frame(spark, names), "publisher")).collect()}
    assert pairs == {("J. Kaferapin", "Kaferapin, J."), ("Clarion, Lagos", "Lagos Clarion"), ("Clarion, Lagos", "lagos  clarion"), ("Lagos Clarion", "lagos  clarion")}


def test_empty(spark):
    assert N.publisher_groups(frame(spark, []), "publisher").count() == 0


def test_near_names_are_all_pairs_above_the_threshold(spark):
    r = random.Random(3)
    cores = {" ".join(sorted({"".join(r.choice("abdeiou") for _ in range(r.randrange(1, 9))) + ":0:0:1" for _ in range(r.randrange(1, 3))})) for _ in range(60)}
    df = spark.createDataFrame([(c,) for c in cores], "core string")
    grams = {}
    for c in cores:
        texts = [f"^{w.split(':')[0]}$" for w in c.split()]
        found = [t[i : i + n] for t in texts for n in (2, 3) for i in range(len(t) - n + 1)]
        grams[c] = {g: found.count(g) for g in found}
    held = {}
    for g in grams.values():
        for k in g:
            held[k] = held.get(k, 0) + 1
    unit = {}
    for c, g in grams.items():
        v = {k: n * math.log(1 + len(cores) / held[k]) ** 2 for k, n in g.items() if held[k] > 1}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        unit[c] = {k: x / norm for k, x in v.items()}
    want = {(a, b): cos for a, b in itertools.combinations(sorted(cores), 2) if (cos := sum(w * unit[b].get(k, 0) for k, w in unit[a].items())) >= 0.25}
    for salt_rows in (2000, 3):  # as if every n-gram were hot
        got = {(r.a, r.b): r.cosine for r in N.near_names(df, 0.25, salt_rows=salt_rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    few = N.near_names(df, 0.25, top_n=1).count()
    assert 0 < few < len(want)


def one_at_a_time(edges, least):
    """Average linkage by always merging the pair of greatest mean likeness."""
    nodes = sorted({x for e in edges for x in e})
    groups = {n: [n] for n in nodes}
    mean = lambda a, b: sum(edges.get((min(x, y), max(x, y)), 0) for x in groups[a] for y in groups[b]) / (len(groups[a]) * len(groups[b]))
    while len(groups) > 1:
        m, a, b = min((-round(mean(a, b), 9), a, b) for a, b in itertools.combinations(sorted(groups), 2))
        if -m < least - 1e-9:
            break
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("seed", range(2))
def test_linkage_is_average_linkage(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(16)]
    edges = {(a, b): round(r.random(), 3) for a, b in itertools.combinations(nodes, 2) if r.random() < 0.4}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a string, b string, likeness double")
    groups = {}
    for row in N.average_linkage(df, 0.4).collect():
        groups.setdefault(row.group_id, []).append(row.name)
    assert sorted(sorted(g) for g in groups.values()) == one_at_a_time(edges, 0.4)
