"""Search workflows: JSON trees of steps, checked and run on the driver over DataFrames."""

from siltstone.workflow.model import WorkflowError, load, validate
from siltstone.workflow.run import Runner

__all__ = ["Runner", "WorkflowError", "load", "validate"]
