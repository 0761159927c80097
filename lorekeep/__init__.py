"""Knowledge-record analytics on Spark: detect, distill, curate, age, check and recall short records."""
