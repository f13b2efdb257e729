"""veilframe: de-identify tables of any size with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from veilframe.operators.clean import clean_sheet, clean_workbook
from veilframe.operators.detect import detect
from veilframe.operators.ids import build_mapping
from veilframe.operators.kanon import equivalence_classes, k_histogram, k_report, workbook_k
from veilframe.operators.preview import preview, preview_meta
from veilframe.operators.registry import Registry
from veilframe.plans.columns import plan_catalog
from veilframe.plans.rules import DEFAULT_RULES, Rule, RuleSet
from veilframe.sources.sheets import Sheet, Workbook

# The few Python functions that run inside tasks travel with the job, so that executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "DEFAULT_RULES",
    "Registry",
    "Rule",
    "RuleSet",
    "Sheet",
    "Workbook",
    "build_mapping",
    "clean_sheet",
    "clean_workbook",
    "detect",
    "equivalence_classes",
    "k_histogram",
    "k_report",
    "plan_catalog",
    "preview",
    "preview_meta",
    "workbook_k",
]
