"""Audited history of status polygons on Spark: diffs, rules, archive, point feeds and read-side queries."""
