"""Layered models (fixed retail model, spec-driven model) and analysis plans over their marts."""
