"""The pipeline of steps, its reports and its retries."""
