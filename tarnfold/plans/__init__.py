"""From texts to plans: the filter language and the commands."""

from .commands import Command, CommandError, parse_command
from .filters import FilterError, compile_filter, parse_filter

__all__ = ["Command", "CommandError", "FilterError", "compile_filter", "parse_command", "parse_filter"]
