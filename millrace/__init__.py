"""millrace: activity, parcel, catalog, job-log, request and text jobs on Spark DataFrames."""
