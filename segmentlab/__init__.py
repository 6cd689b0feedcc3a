"""Corpus-scale operators over timed transcripts, text-box detections and job tables.

Every operator takes DataFrames and returns a lazy DataFrame. Nothing in the
package collects to the driver.
"""
