import pytest
from pyspark.sql import functions as F

from tessera.operators import samples, selection


def test_modes(spark):
    df = spark.createDataFrame([("r1",), (None,)], "report string")
    system = df.select(selection.rendered(selection.messages(F.col("report"), "system_prompt", [("a", "b")])).alias("p")).collect()
    assert system[0].p.startswith("[system]\nChoose agents") and "- a: b" in system[0].p and system[0].p.endswith("[user]\nREPORT IS :\n r1")
    own = df.select(selection.rendered(selection.messages(F.col("report"), "system_prompt", system="be brief")).alias("p")).first()
    assert own.p == "[system]\nbe brief\n[user]\nREPORT IS :\n r1"
    assert [r.p for r in df.select(selection.rendered(selection.messages(F.col("report"), "direct")).alias("p")).collect()] == ["[user]\nr1", "[user]\n"]
    with pytest.raises(ValueError, match="system_prompt, direct"):
        selection.messages(F.col("report"), "other")


def test_replies_that_name_nothing_or_fail(spark):
    class Model:
        def load(self):
            return None

        def generate(self, prompts):
            if any("fail" in p for p in prompts):
                raise TimeoutError("slow")
            return ["no tags" if "none" in p else "<selection><reasoning>x</reasoning><agents><agent><name>a</name><prompt>do</prompt></agent></agents></selection>" for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "none"), (3, "fail")], "id long, report string")
    got = {r.id: r for r in selection.predict(df, Model, "direct").collect()}
    assert (got[1].agents, got[1].prompts, got[1].well_formed, got[1].reasoning, got[1].error) == (["a"], {"a": "do"}, 1.0, "x", None)
    assert (got[2].agents, got[2].well_formed, got[2].raw_output) == ([], 0.0, "no tags")
    assert (got[3].agents, got[3].raw_output) == ([], None) and "slow" in got[3].error


@pytest.mark.parametrize("simple", [True, False])
def test_decision_text_equals_the_plain_one(spark, simple):
    for cases in ([], ["- sample 1: difficulty 3.00, confidence 0.50"]):
        lines = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
        got = spark.range(1).select(selection.decision_text(lines(["- m: s"]), lines(cases), lines(["- a: b"]), simple).alias("p")).first().p
        assert got == samples.decision_prompt(["- m: s"], cases, ["- a: b"], simple)
