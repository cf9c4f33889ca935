"""Errors raised while a job is put together or by its die-on-error checks."""


class FlowError(Exception):
    """Any error of a job."""


class ConfigurationError(FlowError):
    """A setting is missing or wrong."""


class DataValidationError(FlowError):
    """Rows break a rule and the operator is told to stop then."""


class JobAborted(FlowError):
    """A job was told to stop."""

    def __init__(self, message: str, exit_code: int = 1):
        super().__init__(message)
        self.exit_code = exit_code
