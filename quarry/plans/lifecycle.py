"""The three entry points as plans: preprocess, generate and evaluate. Parallel over rows; external calls once per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import cut
from quarry.functions import dsl, metrics
from quarry.operators import evidence, judges, providers, resolve, vectors


def preprocess(records: DataFrame, tagger: Callable, done: DataFrame | None = None, compounds: DataFrame | None = None) -> DataFrame:
    """index, side, pos, entity, tag: the entity table of records not done before.

    compounds (smiles, synonyms): the first synonym without a digit joins as a Chemical where it isn't known yet.
    """
    rows = resolve.remaining(records, done, "index") if done is not None else records
    texts = rows.select("index", F.to_json("perturbations").alias("perturbation"), F.to_json("context").alias("context")).unpivot("index", ["perturbation", "context"], "side", "text")
    distinct = texts.select("text").where("text is not null").distinct()
    tags = cut(providers.tag(distinct.withColumn("key", F.md5(F.col("text").cast("binary"))), "key", "text", tagger))
    found = texts.withColumn("key", F.md5(F.col("text").cast("binary"))).join(tags, "key").select("index", "side", "pos", "entity", "tag")
    if compounds is None:
        return found
    extra = rows.select("index", F.explode("perturbations").alias("p")).select("index", F.col("p.smiles").alias("smiles")).join(compounds, "smiles")
    extra = extra.select("index", dsl.first_without_digit(F.col("synonyms")).alias("entity")).where("entity is not null").distinct()
    extra = extra.join(found.where("side = 'perturbation'"), ["index", "entity"], "left_anti")
    return found.unionByName(extra.select("index", F.lit("perturbation").alias("side"), F.lit(1 << 30).cast("long").alias("pos"), "entity", F.lit("Chemical").alias("tag")))


def generate(records: DataFrame, tools: list[tuple[str, DataFrame]], report_template: str, explain_template: str, primitives: str, question: str, model: Callable[[], providers.Provider], replay: DataFrame | None = None, reports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The report rows and the explanation rows of records (index, perturbation). tools: (name, table of index, info) in order."""
    parts = None
    for pos, (name, info) in enumerate(tools):
        part = info.select("index", F.lit(pos).alias("tool_pos"), evidence.section(F.col("info"), evidence.ToolSpec.parse(name)).alias("info"))
        parts = part if parts is None else parts.unionByName(part)
    rows = records.select("index", "perturbation")
    rows = rows.join(evidence.fan_in(parts), "index", "left") if parts is not None else rows.withColumn("additional_info", F.lit(None).cast("string"))
    rows = rows.withColumn("additional_info", F.coalesce("additional_info", F.lit("")))
    if reports is None:
        asked = rows.withColumn("prompt", evidence.report_prompt(report_template, F.col("perturbation"), F.col("additional_info")))
        written = providers.ask(asked, "prompt", model, replay, "report_text").drop("prompt")
    else:
        written = rows.join(reports.select("index", "report_text"), "index", "left").withColumn("report_text_error", F.lit(None).cast("string"))
    written = cut(written.withColumn("question", F.concat(F.lit(question + "\n"), F.col("perturbation"))))  # the report that is returned is the one that was asked about
    prompt = evidence.explain_prompt(explain_template, action_primitives=F.lit(primitives), report=F.col("report_text"), question=F.col("question"), information=F.col("additional_info"))
    told = providers.ask(written.withColumn("prompt", prompt), "prompt", model, replay, "raw_response")
    names = dict(zip(("thinking", "answer", "explain", "dag"), dsl.SECTIONS))
    explained = told.select("index", F.col("perturbation").alias("input_perturbation"), *(dsl.section(F.col("raw_response"), t).alias(n) for n, t in names.items()), "raw_response", "question", F.col("report_text").alias("input_report_text"), "additional_info", F.col("raw_response_error").alias("error"))
    return written.select("index", "perturbation", "report_text", "question", "additional_info", F.col("report_text_error").alias("error")), explained


METRICS = ("syntax", "token_accuracy", "schema_validity", "id_coherence", "dag_well_formed", "edge_type_accuracy", "primitive_level_f1", "argument_similarity", "llm/correctness", "llm/plausibility")
#: Metrics that need no provider.
OFFLINE = METRICS[:7]


def evaluate(truth: DataFrame, found: DataFrame, vocabulary: list[str], names: tuple[str, ...] = OFFLINE, encoders: dict[str, Callable] | None = None, token_encoders: dict[str, Callable] | None = None, judge: Callable | None = None, correctness_template: str = "", plausibility_template: str = "", rubric: tuple[str, ...] = ()) -> DataFrame:
    """One row of scores per index that both tables have.

    argument_similarity takes encoders of texts, or of their tokens, by mode; llm/... take a judge with a template over
    question, answer and completion, and the keys of the rubric. Answers and questions are used where the metrics ask for them.
    """
    unknown = set(names) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    if "argument_similarity" in names and not (encoders or token_encoders) or any(n.startswith("llm/") for n in names) and judge is None:
        raise ValueError("argument_similarity takes encoders, llm/correctness and llm/plausibility take a judge")
    columns = [c for c in ("index", "explain", "dag", "raw_response", "answer", "question") if c in truth.columns and c in found.columns]
    both = resolve.align(truth.select(*columns), found.select(*columns), "index")
    both = both.withColumn("_a", dsl.edges(F.col("dag_gt"))).withColumn("_b", dsl.edges(F.col("dag_gen")))
    gt, gen = F.col("explain_gt"), F.col("explain_gen")
    scores = {
        "syntax": lambda: {"syntax": metrics.validity(gen, F.array(*map(F.lit, vocabulary)))},
        "token_accuracy": lambda: {"token_accuracy/structure_hypothesis": metrics.token_accuracy(gt, gen, "structure_hypothesis"), "token_accuracy/paragraph": metrics.token_accuracy(F.col("answer_gt"), F.col("answer_gen"), "paragraph")},
        "schema_validity": lambda: {"schema_validity": metrics.schema_validity(F.col("raw_response_gen"))},
        "id_coherence": lambda: {"id_coherence": metrics.id_coherence(gen, F.col("dag_gen"))},
        "dag_well_formed": lambda: {"dag_well_formed": F.when(F.col("dag_gen").isNull(), 0).otherwise(metrics.acyclic(F.col("_b")))},
        "edge_type_accuracy": lambda: {"edge_type_accuracy": metrics.edge_f1(F.col("_a"), F.col("_b"))["f1"]},
        "primitive_level_f1": lambda: {"primitive_level_f1": metrics.multiset_f1(dsl.primitives(gt), dsl.primitives(gen))["f1"]},
    }
    out = []
    for name in [n for n in METRICS if n in names]:
        if name in scores:
            found_ = scores[name]()
            both = both.withColumns(found_)
            out += list(found_)
        elif name == "argument_similarity":
            for score, makers in ((vectors.argument_similarity, encoders), (vectors.greedy_similarity, token_encoders)):
                for mode, make in (makers or {}).items():
                    for part, c in (("paragraph", "answer"), ("structure_hypothesis", "explain")):
                        both = score(both, f"{c}_gt", f"{c}_gen", make, f"argument_similarity/{part}/{mode}")
                        out.append(f"argument_similarity/{part}/{mode}")
        elif name == "llm/correctness":
            both = judges.ask(both, correctness_template, judge, "llm/correctness/full_response", question="question_gt", answer="explain_gt", completion="explain_gen")
            both = both.withColumn(name, metrics.correctness(F.col("llm/correctness/full_response")))
            out += [name, "llm/correctness/full_response"]
        else:
            both = judges.ask(both, plausibility_template, judge, "_judged", question="question_gt", completion="explain_gen")
            parts = {f"{name}/{k}": dsl.judge_scores(F.col("_judged"), list(rubric))[k] for k in rubric}
            both = both.withColumns(parts)
            out += list(parts)
    return both.select("index", *(F.col(f"`{c}`") for c in out))
