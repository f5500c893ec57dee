"""siftlake: training-data selection and corpus processing on Spark."""
