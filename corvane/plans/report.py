"""The text of an evaluation, and where runs are kept.

A report is written by the driver from aggregates and one line per question of a labelled set,
which people read; the tables it is made from stay distributed.
"""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corvane.operators import evaluate

# The report's words.
RUN, RETRIEVAL, ANSWERS, FAILED = "Koşu: ", "Getirme (arama doğru parçayı buldu mu):", "Cevap (doğru dosyaya referans verdi mi):", "Getirmede başarısız sorular:"
RANK, NOT_FOUND, NO_SYMBOL, EXPECTED = "sıra ", "bulunamadı", "  (sembol eksik)", "beklenen: "
NOT_MEASURED = "ölçülmedi (sette sembol beklentisi yok)"


def _interval(low: float, high: float) -> str:
    return f"%95 GA: {low:.0%}-{high:.0%}"


def _retrieval(rows: list[Row], total: Row) -> list[str]:
    out = [RETRIEVAL]
    for r in rows:
        place = f"{RANK}{r['rank']}" if r["rank"] else NOT_FOUND
        out.append(f"  {'✓' if r['found'] else '✗'} {r['question_id']}: {place}{NO_SYMBOL if r['symbols_found'] is False else ''}")
    symbols = NOT_MEASURED if total["symbol_recall"] is None else f"{total['symbol_recall']:.0%}"
    return [
        *out,
        "",
        f"  recall@k     : {total['recall']:.0%}  ({_interval(total['recall_low'], total['recall_high'])}, n={total['n']})",
        f"  kapsam       : {total['coverage']:.0%}  ({_interval(total['coverage_low'], total['coverage_high'])})",
        f"  sembol recall: {symbols}",
        f"  MRR          : {total['mrr']:.3f}",
        "",
    ]


def _answers(rows: list[Row], total: Row) -> list[str]:
    out = [ANSWERS]
    for r in rows:
        warning = f"  ⚠ {r['unverified']} doğrulanamayan" if r["unverified"] else ""
        out.append(f"  {'✓' if r['hit'] else '✗'} {r['question_id']}: kapsam {r['covered']:.0%}, {r['tools']} tool{warning}")
    low, high = total["accuracy_low"], total["accuracy_high"]
    return [
        *out,
        "",
        f"  doğruluk       : {total['accuracy']:.0%}  ({_interval(low, high)}, n={total['n']})",
        f"  dosya kapsamı  : {total['file_coverage']:.0%}",
        f"  uydurma referans: {total['unverified']}",
        f"  cevap başına referans: {total['citations_per_answer']:.1f} dosya",
    ]


def report_text(label: str, questions: DataFrame, results: DataFrame | None = None, answers: DataFrame | None = None) -> str:
    """Q7: the report on one question set.

    ``results`` as from ``evaluate.per_question``; ``answers``: ``question_id citations unverified``
    and, where known, ``tools`` (calls made for the answer). Questions come in order of their ids.
    """
    lines = [f"{RUN}{label}", ""]
    failed: list[str] = []
    if results is not None:
        rows = results.orderBy("question_id").collect()
        if rows:
            lines += _retrieval(rows, evaluate.report(results).first())
            failed = [r["question_id"] for r in rows if not r["found"]]
    if answers is not None:
        each = evaluate.per_answer(questions, answers).orderBy("question_id").collect()
        if each:
            lines += _answers(each, evaluate.answer_report(questions.join(answers.select(F.col("question_id").alias("id")), "id", "left_semi"), answers).first())
    if failed:
        asked = {r["id"]: r for r in questions.filter(F.col("id").isin(failed)).select("id", "question", "expect_files").collect()}
        lines += ["", FAILED]
        for i in failed:
            if i in asked:
                lines += [f"  {i}: {asked[i]['question']}", f"    {EXPECTED}{', '.join(asked[i]['expect_files'])}"]
    return "\n".join(lines)


def save_run(folder: str | Path, label: str, tables: dict[str, DataFrame], now: datetime | None = None) -> Path:
    """One JSON document per run, named by time and label: each table as a list of its rows."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    path = target / f"{now or datetime.now():%Y%m%d-%H%M%S}-{label}.json"
    document = {"label": label} | {name: [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()] for name, df in tables.items()}
    path.write_text(json.dumps(document, ensure_ascii=False, indent=2), encoding="utf-8")
    return path
