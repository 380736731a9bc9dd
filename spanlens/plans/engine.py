"""The whole analysis of documents as a catalogue of lazily built relations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from spanlens.operators import buzzwords, intervals, jobs, metrics, pii, render, repetition, scope, sections, stints
from spanlens.operators.periods import period_rows
from spanlens.sources.documents import load_text
from spanlens.sources.scratch import materialize, release


@dataclass
class Analysis:
    """Relations of documents ``(doc_id, text)``; each is built when first asked for.

    Text is cleaned and personal data is taken out before anything else sees it.
    ``overrides`` replace the kind of lines.  With ``keep``, the relations that
    many findings share are written once to the shared folder, which also cuts
    their lineage; `release` deletes them.
    """

    docs: DataFrame
    now_ym: int
    overrides: DataFrame | None = None
    keep: bool = False

    def __post_init__(self) -> None:
        self._kept: list[DataFrame] = []

    def _shared(self, df: DataFrame) -> DataFrame:
        if not self.keep:
            return df
        self._kept.append(materialize(df, "analysis"))
        return self._kept[-1]

    def release(self) -> None:
        for df in self._kept:
            release(df)
        self._kept.clear()

    @cached_property
    def redacted(self) -> DataFrame:
        # dealt by document once; windows and groups over lines then need no other shuffle
        spark = self.docs.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        docs = self.docs.select("doc_id", "text").repartition(parts, "doc_id")
        return self._shared(pii.redact_documents(load_text(docs)))

    @cached_property
    def pii(self) -> DataFrame:
        return pii.pii_rows(self.redacted)

    @cached_property
    def lines(self) -> DataFrame:
        assigned = sections.assign_lines(sections.line_rows(self.redacted))
        if self.overrides is not None:
            assigned = sections.assign_override(assigned, self.overrides)
        return self._shared(assigned)

    @cached_property
    def blocks(self) -> DataFrame:
        return self._shared(sections.section_blocks(self.lines))

    @cached_property
    def experience(self) -> DataFrame:
        return self._shared(sections.experience_text(self.blocks))

    @cached_property
    def experience_lines(self) -> DataFrame:
        return sections.line_rows(self.experience)

    @cached_property
    def classed_lines(self) -> DataFrame:
        return self._shared(stints.classed_lines(self.experience_lines))

    @cached_property
    def paragraphs(self) -> DataFrame:
        return self._shared(metrics.paragraphs(self.classed_lines))

    @cached_property
    def claims(self) -> DataFrame:
        return metrics.paragraphs(sections.line_rows(sections.kind_text(self.blocks, scope.CLAIMING)))

    @cached_property
    def periods(self) -> DataFrame:
        return self._shared(period_rows(self.experience))

    @cached_property
    def stints(self) -> DataFrame:
        return self._shared(stints.job_stints(self.classed_lines, self.periods))

    @cached_property
    def gaps(self) -> DataFrame:
        return intervals.gaps(self.periods, self.now_ym)

    @cached_property
    def overlaps(self) -> DataFrame:
        return intervals.overlaps(self.periods, self.now_ym)

    @cached_property
    def short_tenures(self) -> DataFrame:
        return intervals.short_tenures(self.periods, self.now_ym)

    @cached_property
    def totals(self) -> DataFrame:
        return intervals.total_months(self.periods, self.now_ym)

    @cached_property
    def next_delta(self) -> DataFrame:
        return intervals.next_delta(self.periods)

    @cached_property
    def timeline(self) -> DataFrame:
        return intervals.timeline_rows(self.periods, self.now_ym)

    @cached_property
    def missing_metrics(self) -> DataFrame:
        return self._shared(metrics.missing_metrics(self.paragraphs, self.stints))

    @cached_property
    def silent_stints(self) -> DataFrame:
        return metrics.silent_stints(self.paragraphs, self.stints)

    @cached_property
    def scope(self) -> DataFrame:
        return self._shared(scope.scope_evidence(self.paragraphs, self.claims))

    @cached_property
    def empty_axes(self) -> DataFrame:
        return scope.scope_empty_axes(self.redacted, self.scope)

    @cached_property
    def buzzwords(self) -> DataFrame:
        return buzzwords.buzzwords(self.redacted)

    @cached_property
    def kind_sections(self) -> DataFrame:
        return self._shared(repetition.kind_sections(self.blocks))

    @cached_property
    def repeated(self) -> DataFrame:
        held = self._shared(repetition.repeating(self.kind_sections))
        return repetition.section_names(repetition.repeated_lines(held), held)

    def answered(self, answers: DataFrame) -> DataFrame:
        return metrics.metric_answers(self.missing_metrics, answers)

    def gate(self, contexts: DataFrame, postings: DataFrame, answers: DataFrame) -> DataFrame:
        return render.phase_gate(contexts, postings, self.stints, self.answered(answers), self.overlaps)

    def findings_text(self, contexts: DataFrame) -> DataFrame:
        return render.render_findings(
            self.redacted, contexts, self.periods, self.next_delta, self.overlaps, self.repeated, self.silent_stints, self.buzzwords, self.pii, self.blocks, self.now_ym
        )

    def jobs_text(self, contexts: DataFrame, postings: DataFrame) -> DataFrame:
        posted = self._shared(jobs.filled_jobs(postings))
        top = jobs.vocabulary_top(self.vocabulary(posted))
        return render.render_jobs(self.redacted, posted, contexts, self.stints, self.totals, top, self._shared(self.requirements(posted)))

    def dossiers(self, contexts: DataFrame, postings: DataFrame, answers: DataFrame, prompt: str = "") -> DataFrame:
        """``(doc_id, markdown)`` of each document that has text, and of postings without one.

        Each block is written before the last join, so that no stage holds the
        operators of all findings at once.
        """
        parts = {
            "state": render.render_state(self.gate(contexts.join(self.redacted.select("doc_id"), "doc_id", "left_semi"), postings, answers)),
            "context": render.render_context(contexts),
            "document": render.render_document(self.blocks),
            "answers": render.render_answers(self.answered(answers)),
            "findings": self.findings_text(contexts),
            "scope": render.render_scope(self.redacted, self.scope),
            "jobs": self.jobs_text(contexts, postings),
        }
        written = {name: materialize(part, name) for name, part in parts.items()}
        return render.dossier(written, self.redacted, prompt)

    def relations(self) -> dict[str, DataFrame]:
        names = (
            "redacted", "pii", "lines", "blocks", "experience", "periods", "stints", "gaps", "overlaps", "short_tenures", "totals", "next_delta",
            "timeline", "missing_metrics", "silent_stints", "scope", "empty_axes", "buzzwords", "repeated",
        )
        return {n: getattr(self, n) for n in names}

    def vocabulary(self, postings: DataFrame) -> DataFrame:
        return jobs.job_vocabulary(postings, self.redacted)

    def requirements(self, postings: DataFrame) -> DataFrame:
        return jobs.job_requirements(jobs.filled_jobs(postings))


def analyze(docs: DataFrame, now_ym: int, overrides: DataFrame | None = None, keep: bool = False) -> dict[str, DataFrame]:
    """All findings on documents ``(doc_id, text)`` by name."""
    return Analysis(docs, now_ym, overrides, keep).relations()


__all__ = ["Analysis", "analyze"]
