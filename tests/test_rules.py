"""Three-valued rules against a plain-Python evaluation over many combinations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sentinela.functions.results import admitted_or_unknown, disposition, emergency_only
from sentinela.operators.cases import derive
from sentinela.syndromes import DIARRHEAL, FEBRILE, RESPIRATORY


def no(a):
    return None if a is None else not a


def both(*values):
    if any(v is False for v in values):
        return False
    return None if any(v is None for v in values) else True


def either(*values):
    if any(v is True for v in values):
        return True
    return None if any(v is None for v in values) else False


def eq(a, b):
    return None if a is None else a == b


def when(test, value):
    return value if test is True else None


def negative(value):
    return both(no(value), value is not None)


def run(spark, syndrome, columns, rows):
    """Decode the rows with Spark; returns one dict per row in input order."""
    kinds = ["string" if any(isinstance(r[i], str) for r in rows) else "int"
             for i in range(len(columns))]
    schema = ", ".join(["row_id int", *(f"{c} {k}" for c, k in zip(columns, kinds))])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    out = derive(df, [syndrome.results(), syndrome.residuals()], ["row_id"])
    return [r.asDict() for r in out.orderBy("row_id").collect()]


def check(got, expected):
    for found, wanted in zip(got, expected, strict=True):
        row_id = found.pop("row_id")
        assert found == wanted, (row_id, found, wanted)


def test_respiratory(spark):
    columns = ["Binax_HizoPrueba", "edadAnios", "Binax_Resultado", "viralPCR_Hizo",
               "viralPCR_FluA", "viralPCR_FluB", "viralPCR_RSV", "viralPCR_hMPV",
               "muestraFroteOPColecta", "muestraFroteNP"]
    tri = (None, 0, 1)
    rows = [(b, a, r, p, fa, fb, rs, hm, op, np_)
            for b, a, r in itertools.product(tri, (None, 17, 18), (None, 0, 1))
            for p, fa, fb in itertools.product(tri, tri, tri)
            for rs, hm in ((0, 0), (1, 0), (None, 0), (0, None))
            for op, np_ in ((None, None), (1, 0), (0, 1), (0, 0))]

    def expected(row):
        b, a, r, p, fa, fb, rs, hm, op, np_ = row
        old = None if a is None else a >= 18
        pneumo = when(both(eq(b, 1), old), eq(r, 1))
        flu = when(eq(p, 1), either(eq(fa, 1), eq(fb, 1)))
        rsv, hmpv = when(eq(p, 1), eq(rs, 1)), when(eq(p, 1), eq(hm, 1))
        return {
            "pneumococcus": pneumo, "flu": flu, "rsv": rsv, "hmpv": hmpv,
            "none": both(negative(pneumo), no(flu), no(rsv), no(hmpv)),
            "not_tested": (op == 1 or np_ == 1) and p != 1,
        }

    got = run(spark, RESPIRATORY, columns, rows)
    check(got, [expected(r) for r in rows])
    assert {g["none"] for g in got} == {True, False, None}
    assert None not in {g["not_tested"] for g in got}


def test_untested_pneumococcus_makes_none_false(spark):
    columns = ["Binax_HizoPrueba", "edadAnios", "Binax_Resultado", "viralPCR_Hizo",
               "viralPCR_FluA", "viralPCR_FluB", "viralPCR_RSV", "viralPCR_hMPV",
               "muestraFroteOPColecta", "muestraFroteNP"]
    row = run(spark, RESPIRATORY, columns, [
        (0, 30, 0, 1, 0, 0, 0, 0, 1, 0), (None, None, None, None, None, None, None, None, 1, 0)])
    assert row[0]["none"] is False and row[1]["none"] is False
    assert row[1]["not_tested"] is True


def test_diarrheal(spark):
    raw = {"emergency": "tamizadoEmergencia", "admitted": "actualAdmitido",
           "campy": "campylobacter", "sal": "salmonella", "shig": "shigella",
           "rota": "rotavirus", "noro1": "RTqPCR_NV1", "noro2": "RTqPCR_NV2",
           "astro": "ASTROVIRUS", "sapo": "SAPOVIRUS"}
    columns = [*raw.values(), "EPEC", "ETEC"]
    draw = random.Random(7)
    rows = [tuple(draw.choice((None, 0, 1)) for _ in columns) for _ in range(3000)]
    rows += [tuple(v for _ in columns) for v in (None, 0, 1)]
    # Only salmonella is positive: it does not count for the residuals.
    rows.append(tuple(1 if c == "salmonella" else 0 for c in columns))
    rows.append(tuple(1 if c == "salmonella" else None for c in columns))
    rows += [tuple(0 for _ in raw) + pair for pair in itertools.product((None, 0, 1), repeat=2)]
    nine = ["campy", "shig", "epec", "etec", "rota", "noro1", "noro2", "sapo", "astro"]

    def expected(row):
        values = dict(zip(columns, row))
        out = {flag: eq(values[c], 1) for flag, c in raw.items()}
        tested = values["EPEC"] is not None or values["ETEC"] is not None
        out["epec"] = when(tested, eq(values["EPEC"], 1))
        out["etec"] = when(tested, eq(values["ETEC"], 1))
        out["none"] = all(out[f] is False for f in nine)
        out["not_tested"] = all(out[f] is None for f in nine)
        return out

    check(run(spark, DIARRHEAL, columns, rows), [expected(r) for r in rows])


def test_febrile(spark):
    numbers = ["dengue_ELISA_lgM", "dengue_PCR", "dengue_tipo1", "dengue_tipo2", "dengue_tipo3",
               "dengue_tipo4", "CHK_IgM", "CHK_PCR", "Zika_PCR"]
    malaria = ["malaria_gotaGruesa", "malaria_PCR"]
    rickettsia = ["rickettsias_ELISA", "rickettsias_IF", "rickettsia_IF_Convaleciente",
                  "rickettsias_PCR"]
    texts = [*malaria, *rickettsia, "Lepto_PanBioKit"]
    columns = [*numbers, *texts]
    draw = random.Random(11)
    rows = [tuple([draw.choice((None, 0, 0, 1)) for _ in numbers]
                  + [draw.choice((None, "NE", "0", "1", "80")) for _ in texts])
            for _ in range(3000)]
    rows.append(tuple([0] * len(numbers) + ["0"] * len(texts)))
    rows.append(tuple([0] * (len(numbers) - 1) + [None] + ["0"] * len(texts)))

    def expected(row):
        v = dict(zip(columns, row))

        def text_rule(names, codes):
            tested = any(v[n] is not None and v[n] not in codes for n in names)
            return when(tested, either(*[eq(v[n], "1") for n in names]))

        out = {
            "dengue": when(
                v["dengue_ELISA_lgM"] is not None or v["dengue_PCR"] is not None,
                either(eq(v["dengue_ELISA_lgM"], 1),
                       *[eq(v[f"dengue_tipo{i}"], 1) for i in range(1, 5)])),
            "chik": when(v["CHK_IgM"] is not None or v["CHK_PCR"] is not None,
                         either(eq(v["CHK_IgM"], 1), eq(v["CHK_PCR"], 1))),
            "zika": eq(v["Zika_PCR"], 1),
            "malaria": text_rule(malaria, ("NE",)),
            "rickettsia": text_rule(rickettsia, ("NE",)),
            "leptospira": text_rule(["Lepto_PanBioKit"], ("NE", "80")),
        }
        four = [out[f] for f in ("dengue", "chik", "zika", "malaria")]
        out["none"] = either(all(f is False for f in four), None)
        out["not_tested"] = any(f is None for f in four)
        return out

    got = run(spark, FEBRILE, columns, rows)
    check(got, [expected(r) for r in rows])
    assert {g["none"] for g in got} == {True, None}


def test_raw_column_differing_in_case_survives_until_all_rules_are_read(spark):
    """A rule after the one named like a raw column still reads the raw codes."""
    df = spark.createDataFrame([(2,)], "EPEC int")
    out = derive(df, [{"epec": F.col("EPEC") == 1, "code": F.col("EPEC")}], []).first()
    assert (out["epec"], out["code"]) == (False, 2)


@pytest.mark.parametrize("admitted,emergency", list(itertools.product((None, False, True), repeat=2)))
def test_dispositions_split_all_cases(spark, admitted, emergency):
    df = spark.createDataFrame([(admitted, emergency)], "a boolean, e boolean")
    a, e = F.col("a"), F.col("e")
    row = df.select(
        admitted_or_unknown(a, e).alias("adm"), emergency_only(a, e).alias("emg"),
        disposition(a, e).alias("d")).first()
    wanted = either(either(admitted, no(emergency)), admitted is None or emergency is None)
    assert row["adm"] == wanted
    assert row["emg"] == both(emergency, no(admitted))
    assert row["d"] == ("emergency" if row["emg"] else "admitted")
    assert (row["d"] == "admitted") == (row["adm"] is True)


def test_text_codes_may_be_stored_as_numbers(spark):
    """A view whose codes happen to be all numeric is read the same way."""
    from sentinela.functions.results import any_equals, decode, has_result

    df = spark.createDataFrame([(1,), (0,), (80,), (None,)], "code int")
    rule = decode(has_result("code", except_codes=("NE", "80")), any_equals("1", "code"))
    assert [r[0] for r in df.select(rule).collect()] == [True, False, None, None]


def test_first_seen_of_ties_does_not_depend_on_the_order_of_rows(spark):
    from sentinela.operators.cases import keep_first_seen

    rows = [("x", 1, flag, n) for flag in (True, False, None) for n in range(5)]
    chosen = set()
    for parts in (1, 3, 7):
        for own in (rows, rows[::-1], rows[7:] + rows[:7]):
            df = spark.createDataFrame(own, "id string, day int, flag boolean, n int").repartition(parts)
            chosen.add(tuple(keep_first_seen(df, ["id"], ["day"]).first()))
    assert len(chosen) == 1
