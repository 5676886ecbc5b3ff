"""Batch import pipelines on Spark: sources, filters, quarantine, identity resolution, runs."""

from .operators.filters import FilterFn
from .operators.resolver import Resolver
from .plans.model import Pipeline, SourceSpec, StepContext, TableHandle, TableSpec
from .plans.stats import Recorder, Scope

__version__ = "0.1.0"
__all__ = ["FilterFn", "Pipeline", "Recorder", "Resolver", "Scope", "SourceSpec", "StepContext", "TableHandle", "TableSpec"]
