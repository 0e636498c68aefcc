"""Log-abuse analytics as Spark jobs: lines -> failures -> ban timeline -> reports."""
