"""The one error type raised for a wrong plan, table or parameter."""


class PlanError(ValueError):
    """A step, table or recipe that cannot be planned."""
