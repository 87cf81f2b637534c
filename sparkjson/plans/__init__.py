"""Composable transforms over a JSON column."""

from .pipeline import Engine, Transform, convert, custom, filtered, formatted, minified, plugin, plugins, validated

__all__ = ["Engine", "Transform", "convert", "custom", "filtered", "formatted", "minified", "plugin", "plugins", "validated"]
