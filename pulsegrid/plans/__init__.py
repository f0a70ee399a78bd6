"""Whole user operations composed of operators: queries over tiers, and rollup maintenance."""
