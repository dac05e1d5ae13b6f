"""contactlens: campaign analytics (profiling, success-rate reports, feature
preparation, classifiers) as Spark DataFrame and Spark ML code."""
