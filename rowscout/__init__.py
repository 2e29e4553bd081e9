"""A Spark-native engine for behavioral queries over time-series logs of moving machines.

The public names below are loaded when they are first used, so that workers which need one module load no others.
"""

from importlib import import_module

_PLACES = {
    "functions.motion": "linear_self_check slerp_self_check",
    "onboarding.adapters": "AdapterRegistry DatasetAdapter get_adapter ingest_manifest inspect_dataset list_adapters register_adapter suggest_manifest validate_manifest",
    "onboarding.records": "DatasetFile DatasetProfile DatasetStream IngestReport ValidationReport",
    "operators.audit": "RangeViolationError",
    "plans.planner": "explain plan plan_batch",
    "plans.query": "query query_batch query_managed_dataset",
    "plans.report": "BatchQueryResult BatchSeekPlan CorrectnessReport EgressLimitError ExtrapolationError QueryResult RowGroupSpan SeekPlan TemporalGapError "
    "TensorCertificate check_finite_tensor_values check_max_velocity check_quaternion_norms check_timestamp_monotonicity",
}
_HOME = {name: module for module, names in _PLACES.items() for name in names.split()}
#: Other names of the two self-checks.
_ALSO = {
    "linear_motion_interpolation_benchmark": "linear_self_check",
    "slerp_constant_angular_velocity_benchmark": "slerp_self_check",
}
__all__ = sorted([*_HOME, *_ALSO])


def __getattr__(name: str):
    real = _ALSO.get(name, name)
    if real not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME[real]}", __name__), real)
