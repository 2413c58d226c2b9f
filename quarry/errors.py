class SpecError(ValueError):
    """A request that names something unknown or has a wrong form."""
