import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.functions import similarity as K
from weftlink.functions.ngrams import word_ngrams

NAMES = [
    ("Acme Pvt. Ltd.", "acme"), ("Smith & Sons, Inc.", "smith and sons"), ("O'Brien Holdings LLC", "obrien"), ("The Group Company", "the"), ("Saint-Gobain S.A.", "saint gobain s a"),
    ("Société Générale SA", "société générale"), ("A.B.C. Corp", "a b c"), ("WhiteAllGraphics.com", "whiteallgraphics com"), ("Private Bank Ltd", "private bank"), ("Private Limited Private Limited", ""),
    ("co.co,co (Ltd) x", "() x"), ("service_co co_x solutions", "service_co co_x"), ("Ésa SAÉ", "ésa saé"), ("Ltd/Inc", "/"), (None, ""),
]
ADDRESSES = [
    ("12 St. John St, Miami, FL 33101", "12 street john street miami floor 33101"), ("Nr. SBI ATM, M.G. Rd, Pune - 411 001", "near sbi atm m g road pune 411 001"),
    ("Opp Mall, Plot #45, Dist. Thane 400601", "opposite mall plot #45 district thane 400601"), ("100 Dr King Dr, Hartford, CT", "100 drive king drive hartford court"), (None, ""),
]
SQUASHED = [("whiteallgraphics com", "whiteallgraphics", "whiteallgraphics"), ("white all graphics", "whiteallgraphics", "whiteallgraphics"), ("smith and sons", "smithsons", "smithandsons"),
            ("brand lincoln computer alpha pllc", "brlolnputerahap", "brandlincolnputeralphapllc")]
KERNELS = [("white all graphics", "whiteallgraphics com", 84.2105, 57.8947, 57.8947), ("acme steel", "steel acme", 50.0, 100.0, 100.0), ("acme steel works", "acme steel", 76.9231, 76.9231, 100.0),
           ("acme steel", "acme stel", 94.7368, 94.7368, 94.7368), ("alpha beta", "gamma delta", 57.1429, 38.0952, 38.0952), ("", "", 100.0, 100.0, 0.0)]


def column(spark, rows, expr):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"x{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_names_and_addresses(spark):
    assert column(spark, [n for n, _ in NAMES], N.normalize_name("x0")) == [w for _, w in NAMES]
    assert column(spark, [a for a, _ in ADDRESSES], N.normalize_address("x0")) == [w for _, w in ADDRESSES]


def test_squash_and_tokens(spark):
    assert column(spark, [s[0] for s in SQUASHED], N.squash("x0")) == [s[1] for s in SQUASHED]
    assert column(spark, [s[0] for s in SQUASHED], N.squash("x0", False)) == [s[2] for s in SQUASHED]
    rows = [("dréxkor 7 eleven", "12 rue 5 avenue 75001 a1 e\u0301tage foo_bar"), ("dréxkor", "étage")]
    got = column(spark, rows, N.blocking_tokens("x0", "x1"))
    assert set(got[0]) == {"12", "75001", "avenue", "eleven", "rue", "tage"} and got[1] == []
    assert column(spark, ["dréxkor étage"], N.blocking_tokens(N.folded("x0"), F.lit(""))) == [["drexkor", "etage"]]
    assert column(spark, ["a bc  def"], N.name_tokens("x0")) == ["bc def"]
    assert column(spark, ["S1-1", "S2-1", "S3-9", "X"], N.source_of("x0")) == ["S1", "S2", "S3", "S3"]


def test_numbers(spark):
    rows = ["12 main 33101 and 400601", "411 001", "x9 7", ""]
    assert column(spark, rows, N.first_postal_code("x0")) == ["33101", None, None, None]
    assert column(spark, rows, N.first_number("x0")) == ["12", "411", "7", None]
    assert column(spark, rows, F.array_sort(N.number_set("x0"))) == [["12", "33101", "400601"], ["001", "411"], [], []]
    assert column(spark, ["10 ca st"], N.expand_states("x0", {"ca": "california"})) == ["10 california st"]


@pytest.mark.parametrize("kernel,at", [(K.ratio, 2), (K.token_sort_ratio, 3), (K.token_set_ratio, 4)])
def test_kernels(spark, kernel, at):
    got = column(spark, [k[:2] for k in KERNELS], kernel(F.col("x0"), F.col("x1")))
    assert got == pytest.approx([k[at] for k in KERNELS], abs=1e-4)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abc é", max_size=12), st.text("abc é", max_size=12))
def test_lcs_and_bounds(a, b):
    assert K.lcs(a, b) == K.lcs(b, a) == slow_lcs(a, b)


WORDS = st.one_of(st.text("abc é\U0001f600", max_size=12), st.text("ab", min_size=60, max_size=70), st.text(max_size=9))


@given(st.lists(st.tuples(WORDS, WORDS), max_size=12))
def test_lengths_of_many_pairs(pairs):
    pairs = [*pairs, *pairs[:2]]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert K.lcs_lengths(a, b).tolist() == [slow_lcs(x, y) for x, y in pairs]


def slow_windows(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    a, b = sorted((a, b), key=len)
    one = lambda a, b: max(200.0 * slow_lcs(a, w) / (len(a) + len(w)) for w in (b[max(0, e - len(a)):e] for e in range(1, len(a) + len(b))))
    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


@given(st.lists(st.tuples(st.text("ab é", max_size=9), st.text("ab é", max_size=14)), max_size=6))
def test_windows_of_many_pairs(pairs):
    got = K.best_windows([x for x, _ in pairs], [y for _, y in pairs])
    assert got == pytest.approx([slow_windows(x, y) for x, y in pairs])


def test_long_texts(spark):
    """Beyond 64 characters and beyond what one SQL integer holds."""
    rows = [("ab c" * 40, "b ca" * 55), ("x" * 300 + "yz", "zy" + "x" * 200), ("word " * 100, "w")]
    got = column(spark, rows, K.ratio(F.col("x0"), F.col("x1")))
    assert got == pytest.approx([200.0 * slow_lcs(a, b) / (len(a) + len(b)) for a, b in rows])


def test_partial_ratio(spark):
    rows = [("abc", "xxabcxx"), ("", ""), ("", "a"), ("abcd", "abxcd")]
    got = column(spark, rows, K.partial_ratio(F.col("x0"), F.col("x1")))
    assert got[:3] == [100.0, 100.0, 0.0] and got[3] == pytest.approx(75.0)


def test_ngrams(spark):
    assert column(spark, ["ab c"], word_ngrams("x0", 3, 4)) == [[" ab", "ab ", " ab ", " c "]]
