import random
import time

import pytest
from pyspark.sql import functions as F

from calgraph.functions import equations as E
from calgraph.functions import maps as M
from calgraph.functions import scalars as S
from calgraph.operators import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("formula, raw, want", [("X", 42, 42), ("x/10", 255, 25.5), ("x-48", 100, 52), ("x*100/32768", 32768, 100), ("x/(10*64)", 640, 1.0), ("5.12/x", 2, 2.56), ("x/2^14", 32768, 2.0), ("(X/k)*10", 100, 200), ("5.12/x", 0, None), ("-x^2", 3, -9), ("x%4", -3, 1), ("2^3^2", 0, 512)])
def test_formulas(spark, formula, raw, want):
    assert value(spark, E.compile_formula(formula, x=F.lit(raw), k=F.lit(5))) == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("formula", ["__import__('os')", "x if x else 0", "open('f')", "x.y", "'a'", "x and 1"])
def test_unsafe_formulas_are_refused(formula):
    with pytest.raises(E.FormulaError):
        E.compile_formula(formula, x=_Never())


class _Never:
    def cast(self, _):
        return self

    def isNotNull(self):
        return self


def test_addresses(spark):
    assert value(spark, S.file_offset(F.lit(0x0006))) == 0x88006
    assert value(spark, S.file_offset(F.lit(0xE42C))) == 0xE42C
    assert value(spark, S.program_address(F.lit(0x8006))) == 0x88006
    assert value(spark, S.program_address(F.lit(0xE42C))) == 0x8E42C


def test_log_values(spark):
    assert value(spark, S.quantise_gradient(F.lit(-139))) == -2
    assert value(spark, S.air_mass(F.lit(0.5), F.lit(3000))) == pytest.approx(163.65, abs=0.1)
    assert value(spark, S.us_to_percent(F.lit(250.0), F.lit(2400.0))) == pytest.approx(3.0)
    assert value(spark, S.us_to_percent(F.lit(780.0), F.lit(1600.0))) == pytest.approx(6.24)


def test_rescaled_axis(spark):
    raw = M.nearest_raw(F.lit(520.0125 * 2.70 / 3.02), 0.04375, 0.0, 16, False)
    assert value(spark, raw["raw"]) == 10627
    assert value(spark, M.nearest_raw(F.lit(9999.0), 0.5, 0.0, 8, False)["outside"])


def test_lookup_is_clamped(spark):
    xs, ys = F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0)), F.array(F.lit(0.0), F.lit(100.0), F.lit(50.0))
    assert [value(spark, M.lookup_curve(xs, ys, F.lit(v))) for v in (-5.0, 0.0, 5.0, 10.0, 15.0, 99.0)] == [0, 0, 50, 100, 75, 50]


@pytest.mark.parametrize("name, shape, signed, width", [("kfs_wint", "map", True, 16), ("kfu_bint", "map", False, 8), ("kls_wint", "curve", True, 16), ("klu_bint", "curve", False, 8), ("tableLookup", "table", False, 0), ("PT1_Filter_US", "filter", False, 0), ("IIR_Filter_US", "filter", False, 0), ("PT1000", None, None, None), ("memcpy", None, None, None)])
def test_helper_names(spark, name, shape, signed, width):
    got = value(spark, S.helper_class(F.lit(name)))
    assert (got.shape, got.signed, got.width) == (shape, signed, width)
    assert value(spark, S.is_helper(F.lit(name))) == (shape is not None or name == "memcpy")


@pytest.mark.parametrize("addr, region", [(0x0, "boot"), (0x100, "boot"), (0x7FFF, "boot"), (0x8000, "rawcal"), (0x9000, "rawcal"), (0xFFFF, "rawcal"), (0x10000, "code"), (0x7FFFF, "code"), (0x80000, "other"), (0x88000, "cal"), (0x8FFFF, "cal"), (0x90000, "other"), (0xF0000, "other"), (0xFF0000, "ram"), (0xFF1000, "ram")])
def test_regions(spark, addr, region):
    assert value(spark, S.region_of(F.lit(addr))) == region


@pytest.mark.parametrize("name, shape", [("KL_TZ", "mnemonic"), ("SWITCH_A", None), ("FUN_A", None), ("switchD_x", None), ("tz_grund", "signal"), ("A_B", None), ("caseD_A", None)])
def test_name_shapes(spark, name, shape):
    assert value(spark, S.name_shape(F.lit(name))) == shape


@pytest.mark.parametrize("text, stamp", [("HW:1 x", True), ("MatchRatio 3", True), ("BlockFound", True), ("created by hand", False), ("v1.2", False)])
def test_stamps(spark, text, stamp):
    assert value(spark, S.is_tool_metadata(F.lit(text))) == stamp


@pytest.mark.parametrize("name, kind", [("kf_abc", "map"), ("KL_X", "curve"), ("k_x", "constant"), ("N", "signal"), ("abc", "unknown")])
def test_kinds_by_prefix(spark, name, kind):
    assert value(spark, S.kind_by_prefix(F.lit(name))) == kind


@pytest.mark.parametrize("name, noise", [("SCARRY4", True), ("abs", True), ("DAT_00ff10", True), ("DAT_ff", False), ("param_1", True), ("0x1f", True), ("12", True), ("x", True), ("N_MOT", False)])
def test_symbol_noise(spark, name, noise):
    assert value(spark, S.is_symbol_noise(F.lit(name))) == noise


@pytest.mark.parametrize(
    "raw, want",
    [
        ("kls_wint(&KL_X.sizeX,N)", "kls_wint(KL_X,N)"), ("table = &KF_TZ_VL", "table = KF_TZ_VL"), ("(a != 0) && (b != 0)", "(a != 0) && (b != 0)"), ("(ushort)x  +  1", "x + 1"), ("(float)x", "x"), ("(Foo *)p", "p"),
        ("ZUSTAND & VL", "ZUSTAND & VL"), ("klu_wint(&curve->sizeX,N)", "klu_wint(curve,N)"),
    ],
)
def test_clean_expression(spark, raw, want):
    assert value(spark, T.clean_expression(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("x << 8 < 100", "x << 8 >= 100"), ("a == 0", "a != 0"), ("a && b", "not (a && b)"), ("flag", "not (flag)"), ("f(a < b)", "not (f(a < b))"), ("(Z & LL) == 0", "(Z & LL) != 0"), ("a <= b", "a > b"), ("f(a && b) > 1", "f(a && b) <= 1"), ("v[i < 2] >= 3", "v[i < 2] < 3")])
def test_invert_guard(spark, raw, want):
    assert value(spark, T.invert_guard(F.lit(raw))) == want


def test_calls_keep_their_nested_arguments(spark):
    text = "f(g(x),y) + kfs_wint({KF_A | KF_B},N,RF) - h( + open("
    got = [(c.callee, c.args) for c in value(spark, T.balanced_calls(F.lit(text)))]
    assert got == [("f", ["g(x)", "y"]), ("g", ["x"]), ("kfs_wint", ["{KF_A | KF_B}", "N", "RF"])]
    i = value(spark, T.interpolations(T.balanced_calls(F.lit(text))))
    assert [(x.helper, x.shape, x.tables, x.axes) for x in i] == [("kfs_wint", "map", ["KF_A", "KF_B"], ["N", "RF"])]


def test_reads_leave_keywords_and_temporaries_out(spark):
    assert value(spark, T.reads_of(F.lit("(unsigned)x + NULL + f(iVar1, N)"))) == ["x", "N"]
    assert value(spark, T.calls_of(F.lit("g(f(a)) + f(b)"))) == ["f", "g"]


@pytest.mark.parametrize("formula, raw, want", [("min(5.12/x,3)", 0, None), ("min(5.12/x,3)", 1, 3), ("max(x,2)", 1, 2), ("round(x/3,1)", 1, 0.3), ("round(x)", 2.5, 2), ("sqrt(x)", -1, None)])
def test_functions_of_formulas(spark, formula, raw, want):
    assert value(spark, E.compile_formula(formula, x=F.lit(raw))) == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("formula", ["round(x,y)", "abs(x,1)", "sqrt()"])
def test_calls_with_wrong_arguments_are_refused(formula):
    with pytest.raises(E.FormulaError):
        E.compile_formula(formula, x=_Never())


def test_guard_gloss(spark):
    words = {"B_LL": "idle", "B_VL": "full load"}
    assert value(spark, T.guard_gloss(F.lit("(STATE & (B_LL|B_VL)) != 0"), words)) == "idle or full load"
    assert value(spark, T.guard_gloss(F.lit("(STATE & (B_LL|B_XX)) != 0"), words)) is None


def test_scanner_takes_the_longest_name_first(spark):
    names = ["KL_TZ_START_TMOT", "KF_TZ_LL", "KF_TZ_GRUND", "KL_TZ_START_N", "KL_TZ", "nr", "nrftm"]
    pages = spark.createDataFrame([("KL_TZ_START_TMOTKF_TZ_LLKF_TZ_GRUNDKL_TZ_START_Nnrftm",), (None,), ("",)], "text string")
    got = [r["names"] for r in T.scan_names(pages, spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    assert got == [["KL_TZ_START_TMOT", "KF_TZ_LL", "KF_TZ_GRUND", "KL_TZ_START_N", "nrftm"], [], []]


def test_scanner_against_plain():
    """Every place and length looked up, the leftmost and then the longest taken."""
    rng = random.Random(2)
    for _ in range(2000):
        names = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(8))}
        text = "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(25)))
        want, at = [], 0
        while at < len(text):
            fit = next((text[at : at + n] for n in range(5, 0, -1) if text[at : at + n] in names), None)
            want += [fit] if fit else []
            at += len(fit or "x")
        assert T.Scanner(sorted(names))(text) == want
    assert T.Scanner([])("abc") == [] and T.Scanner(["a"])(None) == []


def test_scanning_does_not_slow_with_the_names():
    text = " ".join(f"word{i % 977}" for i in range(100_000))
    took = []
    for n in (4, 100_000):
        scan = T.Scanner([f"name_{i:06}" for i in range(n)])
        began = time.perf_counter()
        scan(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 0.2


def splits_into(names, token, least=2):
    reach = [True] + [False] * len(token)
    for j in range(least, len(token) + 1):
        reach[j] = any(reach[i] and token[i:j] in names and j - i < len(token) for i in range(j - least + 1))
    return reach[-1]


def test_glued_names_are_dropped(spark):
    one = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    known, learned = ["B_AFR", "B_LLR_HALT", "K_LLR_TAU", "x"], ["B_AFRB_LLR_HALT", "B_AFR", "K_MD_TZ_CONTROL", "B_AFRB_LLR_HALTK_LLR_TAU", "xx", "B_AFRx"]
    assert sorted(r.name for r in T.drop_concatenations(one(learned), one(known)).collect()) == ["B_AFR", "B_AFRx", "K_MD_TZ_CONTROL", "xx"]
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    assert sorted(r.name for r in T.drop_concatenations(one(names[::2]), one(names)).collect()) == [n for n in names[::2] if not splits_into(set(names), n)]
    assert T.drop_concatenations(one([]), one([])).count() == 0


def test_second_pass_finds_names_in_glued_runs(spark):
    pages = spark.createDataFrame([(1, "the K_LLR_TAU and n_mot stand alone", "de"), (1, "  ", "de"), (2, "K_LLR_TAUn_motKF_TZ and K_LLR_TAUKF_TZ", "en"), (3, None, "en")], "doc long, text string, lang string")
    known = spark.createDataFrame([("KF_TZ",)], "name string")
    got = {r.text: r.names for r in T.two_pass_names(pages, known).collect()}
    assert got["the K_LLR_TAU and n_mot stand alone"] == ["K_LLR_TAU", "n_mot"]
    assert got["K_LLR_TAUn_motKF_TZ and K_LLR_TAUKF_TZ"] == ["K_LLR_TAU", "n_mot", "KF_TZ", "K_LLR_TAU", "KF_TZ"] and got[None] == []
    row = T.learning_stats(pages, known, "doc").first().asDict()
    assert row == {"documents": 3, "german": 1, "english_only": 2, "pages": 2, "known_mnemonics": 1, "known_signals": 0, "learned_mnemonics": 1, "learned_signals": 1, "discarded_mnemonics": 1, "discarded_signals": 0, "found_mnemonics": 2, "found_signals": 1}


LISTING = """void demo(void)

{
  KL_10 *curve;
  unsigned int uPos;
  Foo **pp;
  short buf[4];
  setup(1);
  ushort uVar1;

  curve = &KL_MD;
  int late;
  uVar1 = klu_wint(&curve->sizeX,N);
  p->x = 3;
  x += 1;
  if (a) y = 3;
  int z = 4;
  MD[2] = uVar1 + buf + late;
  return;
}
"""


def test_listing(spark):
    rows = spark.createDataFrame([(1, LISTING), (2, None), (3, ""), (4, "int n;\nN = n;")], "func long, code string")
    assert {(r.func, r.name) for r in T.declared_locals(rows).collect()} == {(1, n) for n in ("curve", "uPos", "pp", "buf", "uVar1")} | {(4, "n")}
    got = [(r.lhs, r.rhs) for r in T.assignments(rows).where("func = 1").orderBy("line").collect()]
    assert got == [("curve", "&KL_MD"), ("uVar1", "klu_wint(&curve->sizeX,N)"), ("p->x", "3"), ("MD[2]", "uVar1 + buf + late")]
    said = [(r.func, r.output, r.expr, r.calls, r.reads) for r in T.listing_statements(rows).orderBy("func", "line").collect()]
    assert said == [(1, "p->x", "3", [], []), (1, "MD[2]", "uVar1 + buf + late", [], ["late"]), (4, "N", "n", [], [])]


def test_tables_of_a_lookup_are_no_locals(spark):
    i = value(spark, T.interpolations(T.balanced_calls(F.lit("klu_wint(curve | KL_X,N)")), F.array(F.lit("curve"))))
    assert i[0].tables == ["KL_X"]


@pytest.mark.parametrize("guard, want", [("(ZUSTAND_MOTOR & (Start|S)) != 0", "cranking (Start) or overrun (Schub)"), ("ZUSTAND_MOTOR & Kl15 aus == 0", "not ignition off (Klemme 15 aus)"), ("(N & LL) == 0", None), ("(START_ST & (LL|Q)) == 0", None), ("x", None), (None, None)])
def test_guards_in_words(spark, guard, want):
    assert value(spark, T.guard_gloss(F.lit(guard).cast("string"), words=T.STATE_WORDS)) == want
