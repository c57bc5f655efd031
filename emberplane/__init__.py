"""emberplane: forest-fuel analytics and corpus preparation as Spark DataFrame operators."""
