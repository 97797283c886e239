"""The whole chain over a folder of daily files: from CSV to serving tables.

    spark-submit --py-files cellgrid.zip daily_run.py RAW_FOLDER OUT_FOLDER
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed import GRID_SIZE, HORIZONS, KNOWN_HOLIDAYS
from ..functions.scalars import with_total_activity
from ..operators import (
    allocation, collapse, diagnosis, features, forecast, reports, serving, thresholds, validation,
)
from ..operators.diagnosis import Holidays
from ..session import configure, materialise
from ..sources.cdr_files import read_daily_files
from ..sources.serving_store import ServingStore
from ..sources.tables import normalise_time, stage

# Names of the stage tables.
AGGREGATED, FLAGS, MEAN_TO_MAX = "cdr_activity_aggregated", "cdr_with_congestion_flags", "cdr_with_loubar"
RISK, DIAGNOSIS, MOVES, COVERAGE = (
    "predicted_risk", "diagnosis_results_1h", "reallocation_results", "reallocation_coverage",
)
# Names chosen here.
ALL_HORIZONS, PATTERNS, ERRORS, QUALITY = "diagnosis_all_horizons", "known_patterns", "forecast_errors", "quality"


@dataclass
class DailyRun:
    spark: SparkSession
    out: str
    grid_size: int = GRID_SIZE
    holidays: Holidays = KNOWN_HOLIDAYS
    horizons: Sequence[int] = HORIZONS
    tz: str | None = None
    long_series: bool = False  # cut each cell's series into blocks of rows, where one is too long for a task

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, f"{self.out}/{name}")

    def ingest(self, raw_folder: str) -> DataFrame:
        raw, roles = read_daily_files(self.spark, raw_folder)
        raw = raw.withColumnsRenamed({roles.cell: "CellID", roles.time: "datetime"})
        collapsed = collapse.collapse_country_codes(raw, activities=roles.activities)
        aggregated = self._stage(normalise_time(collapsed, "datetime", tz=self.tz), AGGREGATED)
        for name, report in collapse.quality_report(raw, aggregated).items():
            self._stage(report, f"{QUALITY}_{name}")
        return aggregated

    def check_patterns(self, aggregated: DataFrame) -> DataFrame:
        return self._stage(validation.known_pattern_report(with_total_activity(aggregated)), PATTERNS)

    def flag(self, aggregated: DataFrame) -> DataFrame:
        return self._stage(thresholds.flag_congestion(with_total_activity(aggregated)), FLAGS)

    def flag_mean_to_max(self, aggregated: DataFrame) -> DataFrame:
        return self._stage(thresholds.flag_mean_to_max(with_total_activity(aggregated)), MEAN_TO_MAX)

    def diagnose(self, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Risk of all horizons and the diagnosis of the first one; that of all is left as a stage table."""
        flags = with_total_activity(flags, only_if_absent=True)
        risk = self._stage(diagnosis.predicted_risk(flags, self.horizons, long_series=self.long_series), RISK)
        every = diagnosis.diagnose_all(risk, self.horizons, holidays=self.holidays, grid_size=self.grid_size)
        self._stage(every, ALL_HORIZONS)
        found = diagnosis.diagnose(risk, self.horizons[0], holidays=self.holidays, grid_size=self.grid_size)
        return risk, self._stage(found, DIAGNOSIS)

    def reallocate(self, risk: DataFrame, diagnosed: DataFrame) -> tuple[DataFrame, DataFrame]:
        horizon = self.horizons[0]
        cases = allocation.routine_cases(diagnosed, horizon)
        edges = allocation.candidate_edges(cases, allocation.capacity(risk, horizon), grid_size=self.grid_size)
        moves = self._stage(allocation.allocate(edges), MOVES)
        return moves, self._stage(allocation.coverage(cases, moves), COVERAGE)

    def publish(self, diagnosed: DataFrame, covered: DataFrame, moves: DataFrame) -> ServingStore:
        store = ServingStore(self.spark, f"{self.out}/serving")
        store.reload(
            serving.build_serving_tables(
                diagnosed, covered, moves, horizon=self.horizons[0], grid_size=self.grid_size
            )
        )
        texts = serving.generate_reports(store.read("cases"), store.read("sources"))
        store.replace("reports", reports.upsert_reports(store.read("reports"), texts))
        return store

    def forecast_errors(self, aggregated: DataFrame) -> DataFrame:
        """Train a model per horizon and stage its errors beside those of the seasonal-naive forecast."""
        matrix = features.forecast_features(with_total_activity(aggregated), grid_size=self.grid_size)
        parts = forecast.chronological_split(features.complete_rows(materialise(matrix, "matrix")))
        train, test = (materialise(p, "split") for p in parts)
        models = forecast.fit_horizons(train, self.horizons, grid_size=self.grid_size)
        predicted = forecast.predict_horizons(test, models, grid_size=self.grid_size)
        return self._stage(forecast.evaluate(predicted, self.horizons), ERRORS)

    def run(self, raw_folder: str, *, train: bool = False) -> ServingStore:
        """Files to serving tables with report texts; ``train`` also fits and measures the forecasting models."""
        aggregated = self.ingest(raw_folder)
        self.check_patterns(aggregated)
        risk, diagnosed = self.diagnose(self.flag(aggregated))
        moves, covered = self.reallocate(risk, diagnosed)
        store = self.publish(diagnosed, covered, moves)
        if train:
            self.forecast_errors(aggregated)
        return store


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("raw_folder")
    parser.add_argument("out_folder")
    parser.add_argument("--grid-size", type=int, default=GRID_SIZE)
    parser.add_argument("--holiday", action="append", default=None, help="yyyy-mm-dd, may be repeated")
    parser.add_argument("--tz", default=None, help="local clock for epoch times; UTC when left out")
    args = parser.parse_args()
    spark = configure(SparkSession.builder.getOrCreate())
    run = DailyRun(
        spark, args.out_folder, grid_size=args.grid_size,
        holidays=tuple(args.holiday) if args.holiday else KNOWN_HOLIDAYS, tz=args.tz,
    )
    run.run(args.raw_folder)


if __name__ == "__main__":
    main()
