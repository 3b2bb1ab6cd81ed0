"""Spark jobs over tables of videos, frames, detections, slots, segments and worker logs."""
