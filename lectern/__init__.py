"""Lectern: article narration and text analytics as Spark plans."""
