"""Plans, runs and analyses large batches of trials as ordinary Spark DataFrame jobs."""
