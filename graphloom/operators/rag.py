"""Prompts from what was retrieved, answers from a model that is handed in, and queries written by a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import sparql_block
from graphloom.operators import retrieve, sparql

Model = Callable[[str], str]

#: What stands where nothing was found: fixed values.
NO_FACTS, NO_RELATED, NO_TEXTS = "(no structured facts found)", "(no KGE-related entities found)", "(no text passages found)"


def joined_blocks(blocks: DataFrame, name: str) -> DataFrame:
    """(qid, name): a question's blocks, one below the other."""
    return blocks.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n").alias(name))


def passages(hits: DataFrame) -> DataFrame:
    """(qid, texts) of hits (qid, place, title, score, text)."""
    line = F.concat(F.lit("["), F.coalesce("title", F.lit("Unknown")), F.lit("] (score: "), F.format_number("score", 3), F.lit(")\n"), F.col("text"))
    return joined_blocks(hits.select("qid", "place", line.alias("block")), "texts").withColumn("texts", F.trim(F.regexp_replace("texts", "\n\\[", "\n\n[")))


#: Hits, without texts, that are broadcast to the documents at most.
MOST_HITS = 100_000


def retrieved(questions: DataFrame, triples: DataFrame, docs: DataFrame, base: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(facts, texts) of questions (qid, question): the facts about what they name, and the nearest of docs (id, title, text)."""
    ents = retrieve.question_entities(questions, retrieve.label_index(triples, base), triples, [base])
    how = "broadcast" if questions.count() * most <= MOST_HITS else "merge"  # else the planner would broadcast documents whose file is small
    hits = retrieve.lexical_topk(questions.select("qid", F.col("question").alias("text")), docs.select("id", "text"), most).hint(how).join(docs, "id")
    return joined_blocks(retrieve.blocks(ents, triples), "facts"), passages(hits)


def context(questions: DataFrame, facts: DataFrame, related: DataFrame, texts: DataFrame) -> DataFrame:
    """Questions (qid, question) with their three sections; the usual words where one is empty."""
    out = questions.join(facts, "qid", "left").join(related, "qid", "left").join(texts, "qid", "left")
    fill = lambda c, x: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(x)).alias(c)
    return out.select("qid", "question", fill("facts", NO_FACTS), fill("related", NO_RELATED), fill("texts", NO_TEXTS))


def prompt(subject: str = "this wiki") -> Column:
    return F.concat(
        F.lit(f"Answer the question about {subject} from the context alone. If the context doesn't hold the answer, say so. Be brief.\n\n=== Knowledge graph facts ===\n"), F.col("facts"),
        F.lit("\n\n=== Related entities ===\n"), F.col("related"), F.lit("\n\n=== Text passages ===\n"), F.col("texts"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nAnswer:"),
    )


def raw_answer() -> Column:
    """The answer without a model: what was retrieved. Its headings are fixed values that results have to equal."""
    return F.concat(F.lit("[No LLM — showing raw retrieval]\n\n--- KG Facts ---\n"), F.col("facts"), F.lit("\n\n--- KGE-Related ---\n"), F.col("related"), F.lit("\n\n--- Text ---\n"), F.col("texts"))


def answered(contexts: DataFrame, model: Model | None = None) -> DataFrame:
    """(qid, question, prompt, answer). A model that fails leaves its error and the context."""
    rows = contexts.select("*", prompt().alias("prompt"), raw_answer().alias("_raw"))
    if model is None:
        return rows.select("qid", "question", "prompt", F.col("_raw").alias("answer"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, facts, texts in zip(pdf["prompt"], pdf["facts"], pdf["texts"], strict=True):
                try:
                    out.append(model(p).strip())
                except Exception as e:  # noqa: BLE001
                    out.append(f"[LLM error: {e}]\n\nRetrieved context:\n{facts}\n\n{texts}")
            yield pdf[["qid", "question", "prompt"]].assign(answer=out)

    kind = dict(rows.dtypes)["qid"]
    return rows.select("qid", "question", "prompt", "facts", "texts").mapInPandas(run, f"qid {kind}, question string, prompt string, answer string")


def history(conversations: DataFrame, shown: int = 200) -> DataFrame:
    """(conv_id, turn, question, answer) with the answer's beginning, in the order of turns."""
    return conversations.select("conv_id", "turn", "question", F.substring("answer", 1, shown).alias("answer")).orderBy("conv_id", "turn")


def query_prompt(summary: str, question: str) -> str:
    return f"Write one SPARQL SELECT query for the question. Use only the prefixes, properties and classes of the summary, plain triple patterns, no SERVICE. Answer with the query alone in a ```sparql block.\n\nSCHEMA SUMMARY:\n{summary}\n\nQUESTION:\n{question}\n"


def repair_prompt(summary: str, question: str, query: str, error: str) -> str:
    return f"The query failed. Write a corrected, simpler one under the same rules.\n\nSCHEMA SUMMARY:\n{summary}\n\nQUESTION:\n{question}\n\nQUERY:\n{query}\n\nERROR:\n{error}\n"


def summary_text(summary: DataFrame) -> str:
    parts: dict[str, list[str]] = {}
    for r in summary.collect():
        parts.setdefault(r["part"], []).append(r["term"])
    return "\n\n".join(f"{k.upper()}:\n" + "\n".join(v) for k, v in parts.items())


def written_query(spark: Any, answer: str) -> str:
    return spark.range(1).select(sparql_block(F.lit(answer)).alias("q")).first()["q"]


def answer_by_query(triples: DataFrame, question: str, summary: str, model: Model, prefixes: dict[str, str] | None = None, repair: bool = True) -> dict[str, Any]:
    """A question answered by a query that the model writes; a query that fails is given back to it once.

    Most errors are found before a job runs. A model that fails is not repaired, nor is an empty result.
    """
    spark = triples.sparkSession
    query, repaired, error = written_query(spark, model(query_prompt(summary, question))), False, None
    for last in (not repair, True):
        try:
            df = sparql.run(triples, query, prefixes)
            return {"question": question, "query": query, "vars": df.columns, "rows": [tuple("None" if x is None else str(x) for x in r) for r in df.collect()], "repaired": repaired, "error": None}
        except Exception as e:  # noqa: BLE001
            error = str(e)
            if last:
                break
            query, repaired = written_query(spark, model(repair_prompt(summary, question, query, error))), True
    return {"question": question, "query": query, "vars": [], "rows": [], "repaired": repaired, "error": error}


def evaluated(triples: DataFrame, questions: list[str], summary: str, model: Model, prefixes: dict[str, str] | None = None) -> list[dict[str, Any]]:
    return [answer_by_query(triples, q, summary, model, prefixes) | {"baseline": model(f"Question: {q}\nAnswer:")} for q in questions]
