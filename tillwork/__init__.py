"""Tillwork: sales cleaning, key figures and report tables for many clients in one Spark job."""
