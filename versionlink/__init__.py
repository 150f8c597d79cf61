"""Record linkage between two versions of one data set, as Spark DataFrame jobs."""
