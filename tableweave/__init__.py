"""Stitch tables with joins, as-of joins and unions, on Spark."""

from .errors import PlanError
from .operators.asof import asof_join, asof_matches, asof_output
from .operators.equi import equi_join, unmatched
from .operators.paging import PageDirectory, page, page_count, page_directory
from .operators.preagg import pre_aggregate
from .operators.prepare import override_types, prepare, project
from .operators.profile import infer_types, profile
from .operators.quality import (
    asof_report,
    asof_unmatched_left,
    asof_unmatched_right,
    equi_report,
    union_report,
)
from .operators.series import (
    event_frames,
    interpolate,
    recorded,
    snapshot,
    summarize,
    to_wide,
)
from .operators.union import union_layout, union_mapped
from .plans.run import load_table, preview_plan, run_plan, run_recipe, run_step
from .plans.specs import (
    OutputSpec,
    PlanSpec,
    Recipe,
    StepSpec,
    TableSpec,
    recipe_from_json,
    recipe_to_json,
)
from .session import configure
