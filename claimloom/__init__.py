"""claimloom: evidence retrieval, claim processing and corpus operators on Spark."""
