"""The library's container writer under the name that the tests use."""

from lamina.sinks.container import *  # noqa: F403
